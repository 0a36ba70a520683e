"""Near duplicates of 64-bit hashes, connected components, and the survivors of a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .tables import discard, materialize

BANDS, BAND_BITS = 4, 16


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in `order`."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_latest(df, keys, [F.col(c).asc() for c in order])


def _band(hash_: Column, i: int) -> Column:
    return F.shiftrightunsigned(hash_, i * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")


def hamming_pairs(df: DataFrame, id_col: str, hash_col: str, most: int = 6) -> DataFrame:
    """(a, b, distance) of all pairs of distinct hash values at most `most` < 8 bits apart, exactly.

    Of four bands of 16 bits one differs in at most one bit, so one side probes each band with its
    value and its 16 neighbours at one flipped bit. Equal hashes are one row, under their smallest
    id, so a hash that many rows share makes no pairs; `hash_members` tells which rows those are.
    """
    if most >= 2 * BANDS:
        raise ValueError("two flipped bits in every band would escape")
    nodes = df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id"))
    bands = F.array(*[F.struct(F.lit(i).alias("band"), _band(F.col("h"), i).alias("value")) for i in range(BANDS)])
    kept = nodes.select("id", "h", F.inline(bands))
    flips = F.array(F.lit(0), *[F.lit(1 << b) for b in range(BAND_BITS)])
    probes = kept.select(F.col("id").alias("pid"), F.col("h").alias("ph"), "band", F.explode(F.transform(flips, lambda x: F.col("value").bitwiseXOR(x))).alias("value"))
    close = C.hamming(F.col("h"), F.col("ph"))
    pairs = kept.join(probes, ["band", "value"]).where((F.col("id") < F.col("pid")) & (close <= most))
    return pairs.select(F.col("id").alias("a"), F.col("pid").alias("b"), close.cast("int").alias("distance")).distinct()


def hash_members(df: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """(a, b) from the smallest id of each hash to the other rows that have it: links, not all pairs."""
    least = df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(id_col).alias("a"))
    return df.join(least, hash_col).where(F.col(id_col) != F.col("a")).select("a", F.col(id_col).alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that the undirected edges (a, b) connect it to.

    Each round takes the least label of the neighbours and then the label of that label.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        told = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("next"))
        made = materialize(told.join(jump, "new").select("node", F.least("new", "next").alias("component"), (F.least("new", "next") != F.col("old")).alias("moved")), "labels")
        moved = made.where("moved").limit(1).count()
        discard(labels)
        labels = made
        if not moved:
            discard(both)
            return labels.select("node", "component")


def near_duplicate_clusters(df: DataFrame, id_col: str, hash_col: str, most: int = 6, confirm: Column | None = None) -> DataFrame:
    """`df` with dup_cluster, the smallest id of its cluster (its own where it has no duplicate).

    `confirm` may rule pairs out by columns of both rows, named a_<column> and b_<column>.
    """
    links = hamming_pairs(df, id_col, hash_col, most)
    if confirm is not None:
        side = lambda x: df.select(*[F.col(c).alias(x if c == id_col else f"{x}_{c}") for c in df.columns])
        links = links.join(side("a"), "a").join(side("b"), "b").where(confirm)
    edges = links.select("a", "b").unionByName(hash_members(df, id_col, hash_col))
    found = components(edges).select(F.col("node").alias(id_col), F.col("component").alias("dup_cluster"))
    return df.join(found, id_col, "left").withColumn("dup_cluster", F.coalesce("dup_cluster", id_col))


def survivors(df: DataFrame, id_col: str, richness: Column, area: Column) -> DataFrame:
    """`df` with removed_reason, null for what a cluster keeps.

    With a val or test member, all train members go (dup_of_eval). Otherwise the best of each split
    stays: most supervision, then largest, then smallest id; others go (near_dup). With a test
    member, all val members go (dup_of_test), whatever was said of them before.
    """
    cluster = Window.partitionBy("dup_cluster")
    best = Window.partitionBy("dup_cluster", "split").orderBy(richness.desc(), area.desc(), F.col(id_col).asc())
    has = lambda *names: F.max(F.col("split").isin(*names)).over(cluster)
    many = F.count("*").over(cluster) > 1
    reason = (
        F.when((F.col("split") == "val") & F.col("__test"), "dup_of_test")
        .when((F.col("split") == "train") & F.col("__eval"), "dup_of_eval")
        .when(F.col("__rank") > 1, "near_dup")
    )
    out = df.withColumns({"__many": many, "__test": has("test"), "__eval": has("val", "test"), "__rank": F.row_number().over(best)})
    return out.withColumn("removed_reason", F.when(F.col("__many"), reason)).drop("__many", "__test", "__eval", "__rank")
