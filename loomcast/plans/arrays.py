"""Queries of arrays: heat maps of vectors, patches, synthetic images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import images, patches
from .base import Query, table
from .evaluation import _AUC


def _heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 heat maps of probabilities."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: C.sigmoid(x.cast("double") * 8)).alias("heat"))


def array_soft_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _heat(spark, sf_dir).select("vec_id", F.posexplode("heat").alias("i", "p"))
    weight = F.pow(F.greatest(F.lit(0.0), F.col("p") - 0.1), 2)
    out = cells.withColumn("w", weight).groupBy("vec_id").agg(F.sum("w").alias("s"), F.sum(F.col("w") * (F.col("i") % 8 + 0.5) / 8).alias("x"), F.sum(F.col("w") * (F.floor(F.col("i") / 8) + 0.5) / 8).alias("y"), F.avg((F.col("p") >= 0.5).cast("int")).alias("share"))
    return out.select("vec_id", F.round(F.col("x") / F.col("s"), 5).alias("cx"), F.round(F.col("y") / F.col("s"), 5).alias("cy"), F.round(F.sqrt("share"), 5).alias("size"))


def array_patch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.explode(C.patch_targets(F.col("heat"), 0.6, 0.4)).alias("target")
    return _heat(spark, sf_dir).select("label", t).groupBy("label", "target").agg(F.count("*").alias("n"))


def array_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and maximum over eight tokens of eight dimensions."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding"), i * 8 + 1, 8))
    out = table(spark, sf_dir, "embeddings").select("vec_id", C.pooled(tokens).alias("p"))
    return out.select("vec_id", F.round(F.col("p")[0], 5).alias("mean0"), F.round(F.col("p")[7], 5).alias("mean7"), F.round(F.col("p")[8], 5).alias("max0"), F.round(F.col("p")[15], 5).alias("max7"))


def math_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where image points look through a flat port."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    out = table(spark, sf_dir, "embeddings").select("vec_id", C.ray_angles(e(1) + 0.5, e(2) + 0.5).alias("a"))
    return out.select("vec_id", F.round("a.yaw", 5).alias("yaw"), F.round("a.pitch", 5).alias("pitch"))


def metric_patch_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat maps against a box in the middle, by label."""
    cover = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when((F.floor(i / 8).between(2, 5)) & ((i % 8).between(2, 5)), 1.0).otherwise(0.0))
    rows = _heat(spark, sf_dir).withColumn("cover", cover)
    cells = patches.labelled(rows, "heat", "cover", F.lit(True))
    truth = rows.select("vec_id", F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"), F.lit(0.5).alias("size"))
    out = patches.block(cells, truth, "vec_id", 8, 8, ["label"])
    return out.select("label", *[F.round(c, 4).alias(c) for c in out.columns if c != "label"])


def array_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = images.find_blobs(_heat(spark, sf_dir), "vec_id", "heat", 8, 8, 0.65, 0.55)
    return out.select("id", "rank", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "size", "mass", "peak")])


def array_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.abs(F.element_at("embedding", i).cast("double"))
    box = F.array(e(1), e(2), F.least(F.lit(1.0), e(1) + 0.3), F.least(F.lit(1.0), e(2) + e(3)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(box).alias("boxes"))
    return images.coverage(rows, "vec_id", "boxes", 4, 4).select(F.col("id").alias("vec_id"), F.round(F.aggregate("coverage", F.lit(0.0), lambda s, x: s + x), 5).alias("patches"))


def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Condition metrics of synthetic scenes and the buckets they fall in."""
    rows = images.measure_images(images.scenes(spark, 24)).drop("thumb")
    return rows.withColumns({"light": C.light_bucket(F.col("lum_mean")), "clarity_bucket": C.clarity_bucket(F.col("clarity"))})


_HEAT = "heat AS (SELECT vec_id, label, list_transform(embedding, lambda x: 1 / (1 + exp(-greatest(-30, least(30, x::DOUBLE * 8))))) AS heat FROM embeddings)"

QUERIES = {
    "array_soft_centroid": Query(
        array_soft_centroid,
        f"""WITH {_HEAT}, c AS (SELECT vec_id, unnest(heat) AS p, generate_subscripts(heat, 1) - 1 AS i FROM heat), w AS (SELECT *, greatest(0, p - 0.1::DOUBLE) ** 2 AS w FROM c)
        SELECT vec_id, round(sum(w * (i % 8 + 0.5::DOUBLE) / 8) / sum(w), 5) AS cx, round(sum(w * (i // 8 + 0.5::DOUBLE) / 8) / sum(w), 5) AS cy, round(sqrt(avg((p >= 0.5)::INTEGER)), 5) AS size FROM w GROUP BY 1""",
    ),
    "array_patch_targets": Query(array_patch_targets, f"WITH {_HEAT}, c AS (SELECT label, unnest(heat) AS p FROM heat) SELECT label, CASE WHEN p >= 0.6 THEN 1 WHEN p <= 0.4 THEN 0 ELSE -1 END AS target, count(*) AS n FROM c GROUP BY 1, 2"),
    "array_pooled": Query(
        array_pooled,
        """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1) % 8 AS d FROM embeddings)
        SELECT vec_id, round(avg(v) FILTER (d = 0), 5) AS mean0, round(avg(v) FILTER (d = 7), 5) AS mean7, round(max(v) FILTER (d = 0), 5) AS max0, round(max(v) FILTER (d = 7), 5) AS max7 FROM c GROUP BY 1""",
    ),
    "math_rays": Query(
        math_rays,
        """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 2 * tan(radians(51.0::DOUBLE)) AS x, embedding[2]::DOUBLE * 2 * tan(radians(33.5::DOUBLE)) AS y FROM embeddings),
        b AS (SELECT *, CASE WHEN sqrt(x * x + y * y) > 1e-12 THEN tan(asin(sin(atan(sqrt(x * x + y * y))) / 1.333::DOUBLE)) / sqrt(x * x + y * y) ELSE 1 END AS s FROM p)
        SELECT vec_id, round(degrees(atan(x * s)), 5) AS yaw, round(degrees(atan2(-y * s, sqrt(1 + x * s * x * s))), 5) AS pitch FROM b""",
    ),
    "metric_patch_block": Query(
        metric_patch_block,
        f"""WITH {_HEAT}, c AS (SELECT vec_id, label, unnest(heat) AS score, generate_subscripts(heat, 1) - 1 AS i FROM heat),
        r AS (SELECT *, (i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5)::INTEGER AS y, greatest(0, score - 0.1::DOUBLE) ** 2 AS w FROM c),
        pooled AS ({_AUC.format(by="label, ", part="label", table="r", group="GROUP BY label")}),
        each AS ({_AUC.format(by="label, vec_id, ", part="label, vec_id", table="r", group="GROUP BY label, vec_id").replace("round(won / (p * q), 6)", "won / (p * q)")}),
        within AS (SELECT label, avg(auc) AS w FROM each WHERE NOT isnan(auc) GROUP BY 1),
        place AS (SELECT label, vec_id, CASE WHEN sum(w) > 1e-12 THEN sum(w * (i % 8 + 0.5::DOUBLE) / 8) / sum(w) END AS cx, CASE WHEN sum(w) > 1e-12 THEN sum(w * (i // 8 + 0.5::DOUBLE) / 8) / sum(w) END AS cy, sqrt(avg((score >= 0.5)::INTEGER)) AS size, arg_max(y, score) AS hit FROM r GROUP BY 1, 2),
        told AS (SELECT *, sqrt(((cx - 0.5::DOUBLE) * 102) ** 2 + ((cy - 0.5::DOUBLE) * 67) ** 2) AS err, CASE WHEN size > 0 AND cx IS NOT NULL THEN abs(ln(size / 0.5::DOUBLE)) END AS off FROM place),
        errs AS (SELECT label, avg((cx IS NOT NULL)::INTEGER) AS found, median(err) AS m, quantile_cont(err, 0.9) AS p, median(off) AS s, avg(hit) FILTER (cx IS NOT NULL) AS h FROM told GROUP BY 1)
        SELECT label, round(auc, 4) AS patch_auc, round(w, 4) AS within_auc, round(found, 4) AS found, round(m, 4) AS error_median, round(p, 4) AS error_p90, round(s, 4) AS size_error, round(h, 4) AS hit_rate FROM pooled JOIN within USING (label) JOIN errs USING (label)""",
    ),
    "array_blobs": Query(
        array_blobs,
        f"""WITH RECURSIVE {_HEAT}, c AS (SELECT vec_id, unnest(heat) AS p, generate_subscripts(heat, 1) - 1 AS i FROM heat),
        r(vec_id, i, part) USING KEY (vec_id, i) AS (SELECT vec_id, i, i FROM c WHERE p >= 0.55 UNION
          (SELECT u.vec_id, u.i, min(v.part) FROM recurring.r u JOIN r v ON v.vec_id = u.vec_id AND abs(v.i // 8 - u.i // 8) <= 1 AND abs(v.i % 8 - u.i % 8) <= 1 WHERE v.part < u.part GROUP BY 1, 2)),
        b AS (SELECT vec_id, part, sum(p * p * (i % 8 + 0.5::DOUBLE) / 8) / sum(p * p) AS cx, sum(p * p * (i // 8 + 0.5::DOUBLE) / 8) / sum(p * p) AS cy, sqrt(count(*) / 64.0::DOUBLE) AS size, sum(p) AS mass, max(p) AS peak FROM r JOIN c USING (vec_id, i) GROUP BY 1, 2)
        SELECT vec_id AS id, (row_number() OVER (PARTITION BY vec_id ORDER BY mass DESC, part) - 1)::INTEGER AS rank, round(cx, 5) AS cx, round(cy, 5) AS cy, round(size, 5) AS size, round(mass, 5) AS mass, round(peak, 5) AS peak FROM b WHERE peak >= 0.65 AND mass >= 0.6""",
    ),
    "array_coverage": Query(
        array_coverage,
        """WITH b AS (SELECT vec_id, abs(embedding[1]::DOUBLE) AS x0, abs(embedding[2]::DOUBLE) AS y0, least(1.0::DOUBLE, abs(embedding[1]::DOUBLE) + 0.3::DOUBLE) AS x1, least(1.0::DOUBLE, abs(embedding[2]::DOUBLE) + abs(embedding[3]::DOUBLE)) AS y1 FROM embeddings),
        c AS (SELECT (range + 0.5::DOUBLE) / 64 AS u FROM range(64))
        SELECT vec_id, round((SELECT count(*) FROM c WHERE u >= x0 AND u < x1) * (SELECT count(*) FROM c WHERE u >= y0 AND u < y1) / 256.0::DOUBLE, 5) AS patches FROM b""",
    ),
    "image_metrics": Query(image_metrics, None),
}
