"""Sampling, caps and balancing weights; every choice is a hash of the id, never of row order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ordering import totals_before


def keep_with(df: DataFrame, keep: Column, unit: Column) -> DataFrame:
    return df.where(unit < keep)


def cap_per_group(df: DataFrame, group: Sequence[str], order: Column, id_col: str, most: int) -> DataFrame:
    """At most `most` rows of each group, by `order` and then id.

    A first pass keeps `most` of each of the group's salted parts, so that a hot group is ranked in
    many tasks and what meets in one is bounded.
    """
    salt = F.pmod(F.xxhash64(id_col), F.lit(64))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*group, *keys).orderBy(order, id_col))
    out = df.withColumn("__salt", salt).withColumn("__n", rank("__salt")).where(F.col("__n") <= most)
    return out.withColumn("__n", rank()).where(F.col("__n") <= most).drop("__salt", "__n")


def stratified(df: DataFrame, strata: Sequence[str], order: Column, id_col: str, total: int) -> DataFrame:
    """`total` rows: an equal share of each stratum, then topped up from the rest, by `order`."""
    n = df.select(*strata).distinct().count()
    share = max(1, total // max(1, n))
    first = cap_per_group(df, strata, order, id_col, share).withColumn("__turn", F.lit(0))
    rest = df.join(first.select(id_col), id_col, "left_anti").withColumn("__turn", F.lit(1))
    return first.unionByName(rest).withColumn("__order", order).orderBy("__turn", "__order", id_col).limit(total).drop("__turn", "__order")


def uniform(df: DataFrame, order: Column, id_col: str, n: int) -> DataFrame:
    return df.orderBy(order, id_col).limit(n)


def balanced(df: DataFrame, positive: Column, order: Column, id_col: str, n: int) -> DataFrame:
    """Half positives and half negatives of `n`; negatives make up for missing positives."""
    pos = df.where(positive).orderBy(order, id_col).limit(n // 2)
    return pos.unionByName(df.where(~positive).orderBy(order, id_col).limit(n - pos.count()))


def bucket_weights(df: DataFrame, train: Column, bucket: Column, cap: float = 8.0) -> DataFrame:
    """`df` with raw_weight: inverse bucket frequency over train, by its median over rows, clipped to
    [1 / cap, cap]; 0 elsewhere. The buckets are few, so they are counted once and joined back."""
    named = df.withColumns({"__train": train, "__bucket": bucket})
    counts = named.where("__train").groupBy("__bucket").agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    inverse = counts.join(F.broadcast(total)).withColumn("__inverse", F.col("__total") / F.col("__n"))
    median = inverse.agg(F.percentile("__inverse", F.lit(0.5), F.col("__n")).alias("__median"))
    weight = F.greatest(F.lit(1.0 / cap), F.least(F.lit(cap), F.col("__inverse") / F.col("__median")))
    table = inverse.join(F.broadcast(median)).select("__bucket", weight.alias("__weight"))
    out = named.join(F.broadcast(table), "__bucket", "left")
    return out.withColumn("raw_weight", F.when(F.col("__train"), F.col("__weight")).otherwise(0.0)).drop("__train", "__bucket", "__weight")


def source_multipliers(sums: Mapping[str, float], caps: Mapping[str, float], rounds: int = 5) -> dict[str, float]:
    """Factors that bring the share of each capped source down to its cap.

    Capping one changes the shares of the others, so it is repeated. A source that is alone cannot be
    a part of itself: its cap is skipped.
    """
    now, out = dict(sums), dict.fromkeys(caps, 1.0)
    for _ in range(rounds):
        total, changed = sum(now.values()), False
        for s, most in caps.items():
            own = now.get(s, 0.0)
            others = sum(now.values()) - own
            if total and own / total > most + 1e-9 and others > 0 and most < 1:
                factor = most * (total - own) / (1 - most) / own
                now[s], out[s], changed = own * factor, out[s] * factor, True
        if not changed:
            break
    return out


def source_capped_weights(df: DataFrame, train: Column, source: str, caps: Mapping[str, float]) -> DataFrame:
    """`df` with weight: raw_weight with capped source shares, its mean over train 1.

    One aggregate of as many rows as there are caps, and one, tells all sums.
    """
    named = F.when(F.col(source).isin(*caps), F.col(source)).otherwise("") if caps else F.lit("")
    sums = {r[0]: (r[1], r[2]) for r in df.where(train).groupBy(named.alias("s")).agg(F.sum("raw_weight"), F.count("*")).collect()}
    factors = source_multipliers({s: w for s, (w, _) in sums.items()}, caps)
    count = sum(n for _, n in sums.values())
    total = sum(w * factors.get(s, 1.0) for s, (w, _) in sums.items())
    factor = F.lit(1.0)
    for s, x in factors.items():
        factor = F.when(F.col(source) == s, F.lit(x)).otherwise(factor)
    return df.withColumn("weight", F.when(train, F.col("raw_weight") * factor / F.lit(total / count if count else 1.0)).otherwise(0.0))


def running_total(df: DataFrame, id_col: str, value: str, ranges: int | None = None) -> DataFrame:
    """`df` with upto, the sum of `value` over smaller ids, which are distinct; by ranges of ids."""
    return totals_before(df, [F.col(id_col)], {"upto": F.col(value)}, ranges=ranges)


def weighted_draws(df: DataFrame, id_col: str, weight: str, draws: int, seed: int, epoch: int = 0, start: int = 0, rank: int = 0, world: int = 1) -> DataFrame:
    """(draw, id): sampling with replacement in proportion to weight; the same draws on every rank.

    Draw k falls at a hashed place of the total weight. Rows cover stretches of it, which are dealt
    to bins, so that draws find their row by an equi join on the bin. Rank r of w takes the draws
    whose number is r modulo w, from draw `start` on.
    """
    placed = running_total(df.where(F.col(weight) > 0).select(id_col, weight), id_col, weight)
    total = placed.agg(F.max(F.col("upto") + F.col(weight))).first()[0] or 0.0
    bins = max(1, min(draws, 1 << 16))
    width = total / bins if total else 1.0
    bin_of = lambda x: F.floor(x / F.lit(width)).cast("long")
    rows = placed.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("upto")), bin_of(F.col("upto") + F.col(weight)))))
    spark = df.sparkSession
    numbers = spark.range(start, draws).where(F.pmod("id", F.lit(world)) == rank).select(F.col("id").alias("draw"))
    points = numbers.withColumn("__u", C.hash01(seed, "draw", F.lit(epoch), F.col("draw")) * F.lit(total)).withColumn("__bin", bin_of(F.col("__u")))
    hit = (F.col("__u") >= F.col("upto")) & (F.col("__u") < F.col("upto") + F.col(weight))
    return points.join(rows, "__bin").where(hit).select("draw", F.col(id_col).alias("id"))


def batches(df: DataFrame, order: Column, id_col: str, size: int, sizes: Sequence[int], seed: int) -> DataFrame:
    """`df` with batch and, the same for a whole batch, resolution.

    Rows are numbered along `order`, by ranges of it.
    """
    numbered = totals_before(df.withColumn("__order", order), [F.col("__order"), F.col(id_col)], {"__first": F.lit(1)})
    out = numbered.withColumn("batch", F.floor(F.col("__first") / size).cast("long"))
    pick = F.floor(C.hash01(seed, "resolution", F.col("batch")) * len(sizes)).cast("int")
    return out.withColumn("resolution", F.element_at(F.array(*map(F.lit, sizes)), pick + 1)).drop("__order", "__first")
