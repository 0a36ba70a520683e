"""The tables of a folder, and the views that queries take of them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


LICENSE_LINE = r"(CC BY-NC 4\.0|CC BY 4\.0|CC0|Apache License|GNU General Public License|MIT License)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as curation records: labels as frame labels, lengths as condition metrics."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = F.col("n_chars")
    out = docs.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    return out.select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("image_id"),
        "source",
        F.concat(F.col("source"), F.lit(":"), (F.col("doc_id") % 40).cast("string")).alias("group_id"),
        C.normalize_license(F.regexp_extract("text", LICENSE_LINE, 1)).alias("license"),
        F.coalesce(F.col("quality").cast("int"), F.lit(-1)).alias("frame_label"),
        F.col("quality").isNotNull().alias("labeled"),
        F.col("toxic").cast("int").alias("toxic"),
        ((n % 1000) / 1000.0).alias("lum_mean"),
        ((n * 7 % 1000) / 1000.0).alias("clarity"),
        ((n % 37) / 1000.0).alias("grad_energy"),
        ((n % 23) / 1000.0).alias("edge_density"),
        n.alias("n_chars"),
        F.md5("text").alias("text_md5"),
        "lang",
    )


RECORDS = f"""
records AS (
  SELECT d.doc_id, 'doc-' || d.doc_id AS image_id, d.source, d.source || ':' || (d.doc_id % 40) AS group_id,
         CASE regexp_extract(d.text, '{LICENSE_LINE}', 1)
           WHEN 'CC BY-NC 4.0' THEN 'CC-BY-NC-4.0' WHEN 'CC BY 4.0' THEN 'CC-BY-4.0' WHEN 'CC0' THEN 'CC0-1.0' ELSE 'unknown' END AS license,
         coalesce(l.quality, -1)::INTEGER AS frame_label, l.quality IS NOT NULL AS labeled, l.toxic::INTEGER AS toxic,
         (d.n_chars % 1000) / 1000.0::DOUBLE AS lum_mean, (d.n_chars * 7 % 1000) / 1000.0::DOUBLE AS clarity,
         (d.n_chars % 37) / 1000.0::DOUBLE AS grad_energy, (d.n_chars % 23) / 1000.0::DOUBLE AS edge_density,
         d.n_chars, md5(d.text) AS text_md5, d.lang
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""

BUCKETED = f"""{RECORDS},
bucketed AS (
  SELECT *, CASE WHEN light = 'dark' THEN 'dark' WHEN clarity_bucket IN ('murky', 'clear') THEN clarity_bucket ELSE 'other' END AS slice,
         CASE WHEN u < 0.10 THEN 'test' WHEN u < 0.15 THEN 'val' ELSE 'train' END AS split
  FROM (
    SELECT *, CASE WHEN lum_mean < 0.10 THEN 'dark' WHEN lum_mean < 0.25 THEN 'dim' ELSE 'bright' END AS light,
           CASE WHEN clarity < 0.35 THEN 'murky' WHEN clarity >= 0.55 THEN 'clear' ELSE 'moderate' END AS clarity_bucket,
           ('0x' || substr(md5('0|split|' || group_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
    FROM records)
)"""


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their condition buckets and grouped split."""
    out = records(spark, sf_dir).withColumns({"light": C.light_bucket(F.col("lum_mean")), "clarity_bucket": C.clarity_bucket(F.col("clarity"))})
    return out.withColumns({"slice": C.eval_slice(F.col("light"), F.col("clarity_bucket")), "split": C.split_of(C.hash01(0, "split", F.col("group_id")), 0.10, 0.05)})


def hash_sql(purpose: str, key: str, seed: int = 0) -> str:
    return f"(('0x' || substr(md5('{seed}|{purpose}|' || {key}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


EPOCH_US = 1704067200000000
STATES = {"view": "SEARCH", "click": "ACQUIRE", "signup": "TRACK", "purchase": "FILM", "error": "SAFE"}


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry frames: users as vehicles, types as states, values as depths; ten hours
    count as a second."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    state = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("vehicle"),
        ((micros - EPOCH_US) / 36e9).alias("t"),
        state.alias("state"),
        F.col("value").alias("depth"),
        k.alias("k"),
        F.when(k % 10 != 0, 30.0 - F.col("value") / 25.0).alias("temp"),
        ((F.col("event_type") == "click") & (k >= 50)).alias("found"),
    )


TELEMETRY = f"""
telemetry AS (
  SELECT event_id, user_id AS vehicle, (epoch_us(ts) - {EPOCH_US}) / 36000000000.0::DOUBLE AS t,
         CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in STATES.items())} END AS state,
         value AS depth, (props->>'$.k')::BIGINT AS k,
         CASE WHEN (props->>'$.k')::BIGINT % 10 <> 0 THEN 30.0::DOUBLE - value / 25.0::DOUBLE END AS temp,
         event_type = 'click' AND (props->>'$.k')::BIGINT >= 50 AS found
  FROM events
),
timed AS (
  SELECT * EXCLUDE (ahead), CASE WHEN ahead IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ahead - t)) END AS dt
  FROM (SELECT *, lead(t) OVER (PARTITION BY vehicle ORDER BY t, event_id) AS ahead FROM telemetry)
)"""


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.telemetry import step_seconds

    return telemetry(spark, sf_dir).withColumn("dt", step_seconds("vehicle", "t", "event_id"))
