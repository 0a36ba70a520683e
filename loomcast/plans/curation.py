"""Queries of dataset curation: scans, filters, buckets, splits, duplicates, samples, weights, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import dedup, joins, metrics, sampling
from ..sources import readers
from .base import BUCKETED, RECORDS, Query, bucketed, hash_sql, records, table

SPLITS, LIGHTS, CLARITIES, SLICES = ("train", "val", "test"), ("dark", "dim", "bright"), ("murky", "moderate", "clear"), ("dark", "murky", "clear", "other")
KEEP = {"default": 0.15, "murky": 0.5, "dark": 0.5}
CAPS = {"src0": 0.02, "src1": 0.03}


def scan_union_dupcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources as one table; ids are unique across them, and a missing source is skipped."""
    parts = [
        table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("image_id"), "source", F.length("text").cast("long").alias("n")),
        table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("image_id"), F.lit("benchmark").alias("source"), F.length("text").cast("long").alias("n")),
    ]
    return readers.union_sources(parts, "image_id")


def filter_license_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("image_id", "license", F.when(~C.commercial_ok(F.col("license")), "license_filter").alias("removed_reason"))


def bucket_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(spark, sf_dir).select("doc_id", "light", "clarity_bucket", "slice", C.is_empty_scene(F.col("grad_energy"), F.col("edge_density")).alias("is_empty"))


def bucket_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.bucket_weights(bucketed(spark, sf_dir), F.lit(True), F.concat_ws("/", "light", "clarity_bucket"))
    return rows.groupBy("source", "light", "clarity_bucket").agg(F.count("*").alias("n"), F.count_if(F.col("frame_label") == 1).alias("n_pos"), F.round(F.max("raw_weight"), 6).alias("weight"))


def keep_prob_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bucketed(spark, sf_dir).where((F.col("split") == "train") & C.is_empty_scene(F.col("grad_energy"), F.col("edge_density")) & ~F.col("labeled") & (F.col("frame_label") != 1))
    return rows.select("doc_id", "slice", "light", C.keep_probability(F.col("slice"), F.col("light"), KEEP).alias("keep_p"))


def empty_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.keep_with(keep_prob_lookup(spark, sf_dir), F.col("keep_p"), C.hash01(0, "empty", F.col("doc_id"))).select("doc_id", "slice")


def join_labels_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", "source", "frame_label", "labeled")


def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def join_dim_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def join_one_to_many_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("parts"), F.count("*").alias("n_lines"))
    out = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", "o_orderstatus", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("parts", F.lit("")).alias("parts"))


def join_three_way_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("clip"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_quantity").alias("most")).where("most > 45").select("key")
    clips = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment") == "BUILDING").alias("completed"))
    return joins.three_way(orders, lines, clips, "key", "clip", "completed").groupBy("outcome").agg(F.count("*").alias("n"), F.sum("key").alias("sum_keys"))


def join_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of all orders against those of all lines, by totals and not by pairs."""
    day = lambda c: F.unix_seconds(F.col(c).cast("timestamp")) / 86400.0
    left = table(spark, sf_dir, "orders").select("o_orderkey", day("o_orderdate").alias("a")).withColumn("b", F.col("a") + 3.0)
    right = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", day("l_shipdate").alias("c")).withColumn("d", F.when(F.col("l_linenumber") < 7, F.col("c") + F.col("l_linenumber")))
    out = joins.overlap_totals(left, right, ("a", "b"), ("c", "d"), "l_orderkey", 8.0)
    return out.select("o_orderkey", "n", F.col("total").alias("sum_keys"), F.round("offset", 3).alias("offset_days"))


def join_nearest_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    out = joins.nearest_remembered(rows, rows.where("vec_id < 64"), "vec_id", "embedding")
    return out.select(F.col("id").alias("vec_id"), F.col("nearest_id"), F.round("similarity", 5).alias("similarity"))


def join_grid_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select("vec_id", (F.element_at("embedding", 1).cast("double") * 100).alias("x"), (F.element_at("embedding", 2).cast("double") * 100).alias("y"))
    cars, animals = points, points.select(F.col("vec_id").alias("animal"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    both = joins.within_radius(cars, animals, ("x", "y"), ("ax", "ay"), 6.0)
    return both.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum("animal").alias("sum_ids"), F.round(F.max("distance"), 4).alias("farthest"))


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("text_md5"))
    return dedup.keep_first(rows, ["text_md5"], ["doc_id"])


def dedup_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return dedup.keep_latest(rows, ["user_id", "event_type"], [F.col("event_id").desc()])


def _near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit hashes that are alike for documents of one source and length: md5 of both, with up to
    four bits turned by the id."""
    id_ = F.col("doc_id")
    turned = F.expr("shiftleft(1L, CAST(doc_id % 64 AS INT)) ^ shiftleft(1L, CAST(doc_id * 7 % 64 AS INT)) ^ shiftleft(1L, CAST(doc_id * 13 % 61 AS INT)) ^ shiftleft(1L, CAST(doc_id % 59 AS INT))")
    base = F.conv(F.substring(F.md5(F.concat_ws("|", "source", F.col("n_chars").cast("string"))), 1, 16), 16, -10).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(id_.isNotNull(), base.bitwiseXOR(turned)).alias("h"))


def dedup_near_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.hamming_pairs(_near_hashes(spark, sf_dir), "doc_id", "h", 6)


def components_min_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts joined by every line."""
    return dedup.components(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 10000000).alias("b")))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bucketed(spark, sf_dir).withColumn("dup_cluster", F.min("doc_id").over(Window.partitionBy("text_md5")))
    return rows


def dedup_survivor_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.survivors(_clusters(spark, sf_dir), "doc_id", C.richness(F.lit(None).cast("string"), F.col("n_chars") % 3, F.col("frame_label")), F.col("n_chars"))
    return out.select("doc_id", "dup_cluster", "split", "removed_reason")


def split_grouped_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(spark, sf_dir).select("doc_id", "group_id", "split")


def split_official(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.when(F.col("doc_id") % 3 == 0, "val").when(F.col("doc_id") % 3 == 1, "dev")
    split = C.split_with_hints(F.col("source"), hint, C.hash01(0, "split", F.col("group_id")), ["src1", "src2"], 0.10, 0.05)
    return records(spark, sf_dir).select("doc_id", split.alias("split"))


def split_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_official(spark, sf_dir).join(records(spark, sf_dir).select("doc_id", "group_id"), "doc_id")
    return rows.groupBy("group_id").agg(F.countDistinct("split").alias("n_splits"), F.count("*").alias("n")).where("n_splits > 1")


def sample_bernoulli_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.keep_with(records(spark, sf_dir), F.lit(0.2), C.hash01(3, "bernoulli", F.col("doc_id"))).select("doc_id", "source")


def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bucketed(spark, sf_dir).select("doc_id", "source", "light", "clarity_bucket")
    return sampling.stratified(rows, ["source", "light", "clarity_bucket"], C.hash01(0, "label", F.col("doc_id")), "doc_id", 150)


def sample_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.uniform(records(spark, sf_dir).select("doc_id", "source"), C.hash01(0, "uniform", F.col("doc_id")), "doc_id", 100)


def sample_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).where("labeled").select("doc_id", "frame_label")
    return sampling.balanced(rows, F.col("frame_label") == 1, C.hash01(0, "balanced", F.col("doc_id")), "doc_id", 60)


def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cap_per_group(records(spark, sf_dir).select("doc_id", "group_id"), ["group_id"], C.hash01(0, "cap", F.col("doc_id")), "doc_id", 2)


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bucket_weights(bucketed(spark, sf_dir), F.col("split") == "train", F.concat_ws("/", "light", "clarity_bucket"))


def weights_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("doc_id", "split", F.round("raw_weight", 6).alias("raw_weight"))


def weights_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.source_capped_weights(_weights(spark, sf_dir), F.col("split") == "train", "source", CAPS)
    return out.groupBy("source").agg(F.round(F.sum("weight"), 4).alias("weight"), F.count("*").alias("n"))


def weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("doc_id", (F.col("n_chars") % 50).cast("double").alias("w"))
    return sampling.weighted_draws(rows, "doc_id", "w", 200, 5).withColumnRenamed("id", "doc_id")


def sample_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("doc_id")
    return sampling.batches(rows, C.hash01(0, "epoch", F.col("doc_id")), "doc_id", 32, [160, 224, 112], 0)


def agg_step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_survivor_leakage(spark, sf_dir).join(records(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return rows.groupBy("split", F.coalesce("removed_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def agg_overview_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_survivor_leakage(spark, sf_dir).join(records(spark, sf_dir).select("doc_id", "source", "frame_label"), "doc_id")
    kept = F.col("removed_reason").isNull()
    counts = [F.count_if(kept & (F.col("split") == s)).alias(f"n_{s}") for s in SPLITS]
    gone = [F.count_if(F.col("removed_reason") == r).alias(r) for r in ("near_dup", "dup_of_eval")]
    labels = [F.count_if(kept & (F.col("frame_label") == v)).alias(n) for v, n in ((1, "pos"), (0, "neg"), (-1, "unknown"))]
    return rows.groupBy("source").agg(F.count_if(kept).alias("kept"), *counts, *gone, *labels).where("kept > 0")


def agg_license_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("ok", C.commercial_ok(F.col("license")).cast("int"))
    return rows.groupBy("license").agg(F.count("*").alias("n"), F.avg("ok").alias("commercial"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def agg_pivot_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(spark, sf_dir).where("split = 'train'").groupBy("light").pivot("clarity_bucket", list(CLARITIES)).count().na.fill(0)


def agg_pivot_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(spark, sf_dir).where("split <> 'train'").groupBy("source", "split").pivot("slice", list(SLICES)).count().na.fill(0)


def agg_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("lum_mean", F.array(*map(F.lit, (0.1, 0.5, 0.9))))
    p = F.percentile("clarity", F.array(*map(F.lit, (0.3, 0.7))))
    out = records(spark, sf_dir).groupBy("source").agg(q.alias("q"), p.alias("p"))
    return out.select("source", *[F.round(F.col("q")[i], 6).alias(f"lum_{n}") for i, n in enumerate(("p10", "median", "p90"))], *[F.round(F.col("p")[i], 6).alias(f"clarity_{n}") for i, n in enumerate(("p30", "p70"))])


def agg_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of thresholds of 99 quantiles that tell light and clarity best."""
    rows = records(spark, sf_dir).where("labeled")
    out = []
    for measure, names in (("lum_mean", LIGHTS), ("clarity", CLARITIES)):
        told = rows.withColumn("label", F.when(F.col("toxic") == 1, names[0]).when(F.col("frame_label") == 0, names[1]).otherwise(names[2]))
        found = metrics.threshold_search(told, measure, "label", names, [i / 100 for i in range(1, 100)])
        out.append(found.select(F.lit(measure).alias("measure"), *[F.round(c, 6).alias(c) for c in ("a", "b", "agreement")]))
    return out[0].unionByName(out[1])


def agg_array_explode_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides in patches of boxes at several input sizes; each component of a vector is a side."""
    sizes = F.explode(F.array(*map(F.lit, (112, 160, 224, 448)))).alias("input")
    boxes = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v"))
    sides = boxes.select("label", (F.abs(F.col("v").cast("double")) * 4).alias("side"), sizes).withColumn("patches", F.col("side") * F.col("input") / 16.0)
    return sides.groupBy("input").agg(F.count("*").alias("n"), F.round(F.avg((F.col("patches") < 1).cast("int")), 6).alias("below_patch"), F.round(F.median("patches"), 5).alias("median_patches"))


def agg_threshold_count_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear rows if there are at least 50, else all; at most 800 of them by hash."""
    rows = bucketed(spark, sf_dir).select("doc_id", "slice")
    clear = rows.where("slice = 'clear'")
    base = clear if clear.limit(50).count() >= 50 else rows
    return sampling.uniform(base, C.hash01(0, "underwater", F.col("doc_id")), "doc_id", 800)


def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("bin", F.least(F.lit(39), F.floor(F.col("lum_mean") * 40)).cast("int"))
    return rows.groupBy("source", "bin").agg(F.count("*").alias("n"))


_TURNED = "xor(xor(1::UBIGINT << (doc_id % 64)::UBIGINT, 1::UBIGINT << (doc_id * 7 % 64)::UBIGINT), xor(1::UBIGINT << (doc_id * 13 % 61)::UBIGINT, 1::UBIGINT << (doc_id % 59)::UBIGINT))"
_NEAR = f"xor(('0x' || substr(md5(source || '|' || n_chars), 1, 16))::UBIGINT, {_TURNED})"
_SURVIVORS = f"""{BUCKETED},
clustered AS (SELECT *, min(doc_id) OVER (PARTITION BY text_md5) AS dup_cluster FROM bucketed),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY dup_cluster) AS members, bool_or(split = 'test') OVER (PARTITION BY dup_cluster) AS has_test,
         bool_or(split <> 'train') OVER (PARTITION BY dup_cluster) AS has_eval,
         row_number() OVER (PARTITION BY dup_cluster, split ORDER BY (CASE WHEN n_chars % 3 > 0 THEN 2 ELSE 0 END + CASE WHEN frame_label <> -1 THEN 1 ELSE 0 END) DESC, n_chars DESC, doc_id) AS rn
  FROM clustered),
survivors AS (
  SELECT doc_id, dup_cluster, split, source, frame_label, CASE WHEN members = 1 THEN NULL WHEN split = 'val' AND has_test THEN 'dup_of_test'
         WHEN split = 'train' AND has_eval THEN 'dup_of_eval' WHEN rn > 1 THEN 'near_dup' END AS removed_reason FROM ranked)"""
_WEIGHTS = f"""{BUCKETED},
counts AS (SELECT light || '/' || clarity_bucket AS bucket, count(*) AS n FROM bucketed WHERE split = 'train' GROUP BY 1),
inverse AS (SELECT bucket, n, (SELECT sum(n) FROM counts)::DOUBLE / n AS inv FROM counts),
med AS (SELECT median(i.inv) AS m FROM bucketed b JOIN inverse i ON b.light || '/' || b.clarity_bucket = i.bucket WHERE split = 'train'),
weighted AS (SELECT b.*, CASE WHEN split = 'train' THEN greatest(0.125::DOUBLE, least(8.0::DOUBLE, inv / (SELECT m FROM med))) ELSE 0.0::DOUBLE END AS raw_weight
  FROM bucketed b LEFT JOIN inverse i ON b.light || '/' || b.clarity_bucket = i.bucket)"""
_OFFICIAL = f"""{RECORDS},
official AS (SELECT doc_id, group_id, CASE WHEN source IN ('src1', 'src2') AND doc_id % 3 = 0 THEN 'val'
  WHEN {hash_sql('split', 'group_id')} < 0.10 THEN 'test' WHEN {hash_sql('split', 'group_id')} < 0.15 THEN 'val' ELSE 'train' END AS split FROM records)"""
_CANDIDATES = f"""{BUCKETED},
candidates AS (SELECT doc_id, slice, light, CASE WHEN slice IN ('murky', 'dark') THEN 0.5::DOUBLE WHEN light = 'dark' THEN 0.5::DOUBLE ELSE 0.15::DOUBLE END AS keep_p
  FROM bucketed WHERE split = 'train' AND grad_energy < 0.012 AND edge_density < 0.01 AND NOT labeled AND frame_label <> 1)"""

QUERIES = {
    "scan_union_dupcheck": Query(scan_union_dupcheck, "SELECT 'doc-' || doc_id AS image_id, source, length(text)::BIGINT AS n FROM documents UNION ALL SELECT 'item-' || item_id, 'benchmark', length(text)::BIGINT FROM benchmark"),
    "filter_license_tagged": Query(filter_license_tagged, f"WITH {RECORDS} SELECT image_id, license, CASE WHEN license IN ('unknown', 'CC-BY-NC-4.0') THEN 'license_filter' END AS removed_reason FROM records"),
    "bucket_slice": Query(bucket_slice, f"WITH {BUCKETED} SELECT doc_id, light, clarity_bucket, slice, grad_energy < 0.012 AND edge_density < 0.01 AS is_empty FROM bucketed"),
    "bucket_balance": Query(
        bucket_balance,
        f"""WITH {BUCKETED}, counts AS (SELECT light, clarity_bucket, count(*) AS c FROM bucketed GROUP BY 1, 2),
        inverse AS (SELECT *, (SELECT sum(c) FROM counts)::DOUBLE / c AS inv FROM counts),
        med AS (SELECT median(inv) AS m FROM bucketed JOIN inverse USING (light, clarity_bucket))
        SELECT source, light, clarity_bucket, count(*) AS n, count(*) FILTER (frame_label = 1) AS n_pos,
        round(max(greatest(0.125::DOUBLE, least(8.0::DOUBLE, inv / (SELECT m FROM med)))), 6) AS weight FROM bucketed JOIN inverse USING (light, clarity_bucket) GROUP BY 1, 2, 3""",
    ),
    "keep_prob_lookup": Query(keep_prob_lookup, f"WITH {_CANDIDATES} SELECT * FROM candidates"),
    "empty_downsample": Query(empty_downsample, f"WITH {_CANDIDATES} SELECT doc_id, slice FROM candidates WHERE {hash_sql('empty', 'doc_id')} < keep_p"),
    "join_labels_left": Query(join_labels_left, f"WITH {RECORDS} SELECT doc_id, source, frame_label, labeled FROM records"),
    "join_semi": Query(join_semi, "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "join_anti": Query(join_anti, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "join_dim_broadcast": Query(join_dim_broadcast, "SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3"),
    "join_one_to_many_collect": Query(
        join_one_to_many_collect,
        """SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS parts
        FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    ),
    "join_three_way_outcome": Query(
        join_three_way_outcome,
        """SELECT CASE WHEN completed IS NULL THEN 'dropped' WHEN boxed THEN 'boxed' WHEN completed THEN 'empty' ELSE 'dropped' END AS outcome, count(*) AS n, sum(o_orderkey)::BIGINT AS sum_keys
        FROM (SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS boxed,
          CASE WHEN c_acctbal > 0 THEN c_mktsegment = 'BUILDING' END AS completed FROM orders LEFT JOIN customer ON o_custkey = c_custkey) GROUP BY 1""",
    ),
    "join_interval_overlap": Query(
        join_interval_overlap,
        """WITH l AS (SELECT o_orderkey, epoch(o_orderdate) / 86400.0::DOUBLE AS a, epoch(o_orderdate) / 86400.0::DOUBLE + 3 AS b FROM orders),
        r AS (SELECT l_orderkey, epoch(l_shipdate) / 86400.0::DOUBLE AS c, CASE WHEN l_linenumber < 7 THEN epoch(l_shipdate) / 86400.0::DOUBLE + l_linenumber END AS d FROM lineitem)
        SELECT o_orderkey, count(*) AS n, sum(l_orderkey)::BIGINT AS sum_keys, round(sum(greatest(0.0::DOUBLE, a - c)), 3) AS offset_days FROM l JOIN r ON c <= b AND (d IS NULL OR d >= a) GROUP BY 1""",
    ),
    "join_nearest_cosine": Query(
        join_nearest_cosine,
        """SELECT vec_id, nearest_id, round(s, 5) AS similarity FROM (
          SELECT q.vec_id, m.vec_id AS nearest_id, s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, m.vec_id) AS rn
          FROM embeddings q, embeddings m, LATERAL (SELECT list_cosine_similarity(q.embedding::DOUBLE[], m.embedding::DOUBLE[]) AS s) WHERE m.vec_id < 64) WHERE rn = 1""",
    ),
    "join_grid_radius": Query(
        join_grid_radius,
        """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings)
        SELECT a.vec_id, count(*) AS n, sum(b.vec_id)::BIGINT AS sum_ids, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 4) AS farthest
        FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 6.0 GROUP BY 1""",
    ),
    "dedup_exact": Query(dedup_exact, "SELECT doc_id, source, text_md5 FROM (SELECT doc_id, source, md5(text) AS text_md5, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"),
    "dedup_keep_latest": Query(dedup_keep_latest, "SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1"),
    "dedup_near_bands": Query(
        dedup_near_bands,
        f"""WITH h AS (SELECT min(doc_id) AS id, {_NEAR} AS h FROM documents GROUP BY 2)
        SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 6""",
    ),
    "components_min_label": Query(
        components_min_label,
        """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, l_partkey + 10000000 AS b FROM lineitem), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM s UNION
          (SELECT u.node, min(v.component) FROM recurring.r u JOIN s ON s.a = u.node JOIN r v ON v.node = s.b WHERE v.component < u.component GROUP BY u.node))
        SELECT node, component FROM r""",
    ),
    "dedup_survivor_leakage": Query(dedup_survivor_leakage, f"WITH {_SURVIVORS} SELECT doc_id, dup_cluster, split, removed_reason FROM survivors"),
    "split_grouped_hash": Query(split_grouped_hash, f"WITH {BUCKETED} SELECT doc_id, group_id, split FROM bucketed"),
    "split_official": Query(split_official, f"WITH {_OFFICIAL} SELECT doc_id, split FROM official"),
    "split_leak_check": Query(split_leak_check, f"WITH {_OFFICIAL} SELECT group_id, count(DISTINCT split) AS n_splits, count(*) AS n FROM official GROUP BY 1 HAVING count(DISTINCT split) > 1"),
    "sample_bernoulli_hash": Query(sample_bernoulli_hash, f"SELECT doc_id, source FROM documents WHERE {hash_sql('bernoulli', 'doc_id', 3)} < 0.2"),
    "sample_stratified": Query(
        sample_stratified,
        f"""WITH {BUCKETED}, k AS (SELECT greatest(1, 150 // count(*)) AS share FROM (SELECT DISTINCT source, light, clarity_bucket FROM bucketed)),
        o AS (SELECT doc_id, source, light, clarity_bucket, {hash_sql('label', 'doc_id')} AS h FROM bucketed),
        n AS (SELECT *, row_number() OVER (PARTITION BY source, light, clarity_bucket ORDER BY h, doc_id) AS rn FROM o)
        SELECT doc_id, source, light, clarity_bucket FROM n ORDER BY rn > (SELECT share FROM k), h, doc_id LIMIT 150""",
    ),
    "sample_uniform": Query(sample_uniform, f"SELECT doc_id, source FROM documents ORDER BY {hash_sql('uniform', 'doc_id')}, doc_id LIMIT 100"),
    "sample_balanced": Query(
        sample_balanced,
        f"""WITH {RECORDS}, o AS (SELECT doc_id, frame_label, row_number() OVER (PARTITION BY frame_label = 1 ORDER BY {hash_sql('balanced', 'doc_id')}, doc_id) AS rn, least(30, (SELECT count(*) FROM records WHERE frame_label = 1)) AS p FROM records WHERE labeled)
        SELECT doc_id, frame_label FROM o WHERE rn <= CASE WHEN frame_label = 1 THEN p ELSE 60 - p END""",
    ),
    "cap_per_group": Query(cap_per_group, f"WITH {RECORDS} SELECT doc_id, group_id FROM (SELECT doc_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY {hash_sql('cap', 'doc_id')}, doc_id) AS rn FROM records) WHERE rn <= 2"),
    "weights_bucket": Query(weights_bucket, f"WITH {_WEIGHTS} SELECT doc_id, split, round(raw_weight, 6) AS raw_weight FROM weighted"),
    "weights_source_cap": Query(
        weights_source_cap,
        f"""WITH RECURSIVE {_WEIGHTS},
        sums AS (SELECT sum(raw_weight) FILTER (source = 'src0') AS a, sum(raw_weight) FILTER (source = 'src1') AS b, sum(raw_weight) FILTER (source NOT IN ('src0', 'src1')) AS o, count(*) AS n FROM weighted WHERE split = 'train'),
        steps(k, a, b, o, tot) AS (SELECT 0, a, b, o, a + b + o FROM sums UNION ALL
          SELECT k + 1, CASE WHEN k % 2 = 0 AND a / tot > 0.02::DOUBLE + 1e-9 THEN 0.02::DOUBLE * (tot - a) / (1 - 0.02::DOUBLE) ELSE a END,
                 CASE WHEN k % 2 = 1 AND b / tot > 0.03::DOUBLE + 1e-9 THEN 0.03::DOUBLE * (tot - b) / (1 - 0.03::DOUBLE) ELSE b END, o, CASE WHEN k % 2 = 1 THEN a + CASE WHEN b / tot > 0.03::DOUBLE + 1e-9 THEN 0.03::DOUBLE * (tot - b) / (1 - 0.03::DOUBLE) ELSE b END + o ELSE tot END FROM steps WHERE k < 10),
        told AS (SELECT s.a / z.a AS fa, s.b / z.b AS fb, (s.a + s.b + s.o) / z.n AS mean FROM steps s, sums z WHERE s.k = 10)
        SELECT source, round(sum(CASE WHEN split = 'train' THEN raw_weight * CASE source WHEN 'src0' THEN fa WHEN 'src1' THEN fb ELSE 1 END / mean ELSE 0 END), 4) AS weight, count(*) AS n FROM weighted, told GROUP BY 1""",
    ),
    "weighted_draw": Query(
        weighted_draw,
        f"""WITH w AS (SELECT doc_id, (n_chars % 50)::DOUBLE AS w FROM documents WHERE n_chars % 50 > 0),
        c AS (SELECT doc_id, w, coalesce(sum(w) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM w),
        d AS (SELECT range AS draw, {hash_sql('draw|0', 'range', 5)} * (SELECT sum(w) FROM w) AS u FROM range(200))
        SELECT draw, doc_id FROM d JOIN c ON u >= upto AND u < upto + w""",
    ),
    "sample_batches": Query(
        sample_batches,
        f"""WITH n AS (SELECT doc_id, (row_number() OVER (ORDER BY {hash_sql('epoch', 'doc_id')}, doc_id) - 1) // 32 AS batch FROM documents)
        SELECT doc_id, batch::BIGINT AS batch, ([160, 224, 112])[floor({hash_sql('resolution', 'batch')} * 3)::INTEGER + 1]::INTEGER AS resolution FROM n""",
    ),
    "agg_step_counts": Query(agg_step_counts, f"WITH {_SURVIVORS} SELECT split, coalesce(removed_reason, 'kept') AS reason, count(*) AS n FROM survivors GROUP BY 1, 2"),
    "agg_overview_source": Query(
        agg_overview_source,
        f"""WITH {_SURVIVORS}, k AS (SELECT *, removed_reason IS NULL AS keep FROM survivors)
        SELECT source, count(*) FILTER (keep) AS kept, {", ".join(f"count(*) FILTER (keep AND split = '{s}') AS n_{s}" for s in SPLITS)},
        count(*) FILTER (removed_reason = 'near_dup') AS near_dup, count(*) FILTER (removed_reason = 'dup_of_eval') AS dup_of_eval,
        count(*) FILTER (keep AND frame_label = 1) AS pos, count(*) FILTER (keep AND frame_label = 0) AS neg, count(*) FILTER (keep AND frame_label = -1) AS unknown FROM k GROUP BY 1 HAVING count(*) FILTER (keep) > 0""",
    ),
    "agg_license_table": Query(agg_license_table, f"WITH {RECORDS} SELECT license, count(*) AS n, avg((license NOT IN ('unknown', 'CC-BY-NC-4.0'))::INTEGER) AS commercial, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM records GROUP BY 1"),
    "agg_pivot_grid": Query(agg_pivot_grid, f"WITH {BUCKETED} SELECT light, {', '.join(f"count(*) FILTER (clarity_bucket = '{c}') AS {c}" for c in CLARITIES)} FROM bucketed WHERE split = 'train' GROUP BY 1"),
    "agg_pivot_slices": Query(agg_pivot_slices, f"WITH {BUCKETED} SELECT source, split, {', '.join(f"count(*) FILTER (slice = '{c}') AS {c}" for c in SLICES)} FROM bucketed WHERE split <> 'train' GROUP BY 1, 2"),
    "agg_quantiles": Query(
        agg_quantiles,
        f"""WITH {RECORDS} SELECT source, {', '.join(f'round(quantile_cont(lum_mean, {q}), 6) AS lum_{n}' for q, n in ((0.1, 'p10'), (0.5, 'median'), (0.9, 'p90')))},
        round(quantile_cont(clarity, 0.3), 6) AS clarity_p30, round(quantile_cont(clarity, 0.7), 6) AS clarity_p70 FROM records GROUP BY 1""",
    ),
    "agg_threshold_search": Query(
        agg_threshold_search,
        f"""WITH {RECORDS}, m AS (SELECT 'lum_mean' AS measure, lum_mean AS v, toxic, frame_label FROM records WHERE labeled UNION ALL SELECT 'clarity', clarity, toxic, frame_label FROM records WHERE labeled),
        r AS (SELECT measure, v, CASE WHEN toxic = 1 THEN 0 WHEN frame_label = 0 THEN 1 ELSE 2 END AS label FROM m),
        g AS (SELECT DISTINCT measure, unnest(quantile_cont(v, [{', '.join(f'{i / 100}' for i in range(1, 100))}])) AS v FROM r GROUP BY measure),
        p AS (SELECT measure, x.v AS a, y.v AS b, avg((CASE WHEN r.v < x.v THEN 0 WHEN r.v < y.v THEN 1 ELSE 2 END = label)::INTEGER) AS agreement FROM r JOIN g x USING (measure) JOIN g y USING (measure) WHERE x.v <= y.v GROUP BY 1, 2, 3)
        SELECT measure, round(a, 6) AS a, round(b, 6) AS b, round(agreement, 6) AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY agreement DESC, a, b) AS rn FROM p) WHERE rn = 1""",
    ),
    "agg_array_explode_sizes": Query(
        agg_array_explode_sizes,
        """WITH s AS (SELECT abs(unnest(embedding)::DOUBLE) * 4 AS side FROM embeddings), i AS (SELECT unnest([112, 160, 224, 448])::INTEGER AS input)
        SELECT input, count(*) AS n, round(avg((side * input / 16.0::DOUBLE < 1)::INTEGER), 6) AS below_patch, round(median(side * input / 16.0::DOUBLE), 5) AS median_patches FROM s, i GROUP BY 1""",
    ),
    "agg_threshold_count_switch": Query(
        agg_threshold_count_switch,
        f"""WITH {BUCKETED}, c AS (SELECT count(*) FILTER (slice = 'clear') AS n FROM bucketed)
        SELECT doc_id, slice FROM bucketed, c WHERE slice = 'clear' OR n < 50 ORDER BY {hash_sql('underwater', 'doc_id')}, doc_id LIMIT 800""",
    ),
    "agg_histogram": Query(agg_histogram, f"WITH {RECORDS} SELECT source, least(39, floor(lum_mean * 40))::INTEGER AS bin, count(*) AS n FROM records GROUP BY 1, 2"),
}
