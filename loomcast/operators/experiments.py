"""Tables of experiments: settings grids, latencies, and variants against a reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.writers import markdown


def grid(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str], error: str = "error") -> DataFrame:
    """(keys, runs, <metric>_mean, <metric>_sd) of the runs without an error; one run has no spread.
    Keys sort as text."""
    sd = lambda m: F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_sd")
    out = runs.where(F.col(error).isNull()).groupBy(*keys).agg(F.count("*").alias("runs"), *[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), sd(m))])
    return out.orderBy(*[F.col(k).cast("string") for k in keys])


def grid_report(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str], error: str = "error") -> str:
    told = grid(runs, keys, metrics, error)
    cell = lambda m: F.format_string("%.1f ± %.1f", F.col(f"{m}_mean"), F.col(f"{m}_sd")).alias(m)
    failed = runs.where(F.col(error).isNotNull()).count()
    return markdown(told.select(*keys, "runs", *[cell(m) for m in metrics])) + (f"\n{failed} runs failed.\n" if failed else "")


def latency(rows: DataFrame, keys: Sequence[str], ms: str) -> DataFrame:
    """(keys, n, mean, p50, p90, p99, fps) of latencies."""
    q = F.percentile(ms, F.array(*map(F.lit, (0.5, 0.9, 0.99)))).alias("q")
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(ms).alias("mean"), q)
    return out.select(*keys, "n", "mean", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((50, 90, 99))], F.try_divide(F.lit(1000.0), F.col("mean")).alias("fps"))


def with_costs(results: DataFrame, costs: DataFrame, parts: Sequence[str], key: str = "model") -> DataFrame:
    """Results with the costs of their model, whose name is made of `parts`; those without costs stay."""
    return results.join(F.broadcast(costs), F.concat_ws("_", *[F.col(p).cast("string") for p in parts]) == F.col(key), "left").drop(key)


def against(results: DataFrame, variant: str, reference: str, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Results with delta_<metric> to the reference variant of the same keys."""
    base = results.where(F.col(variant) == reference).select(*keys, *[F.col(m).alias(f"__{m}") for m in metrics])
    out = results.join(base, list(keys), "left") if keys else results.crossJoin(F.broadcast(base))
    return out.withColumns({f"delta_{m}": F.col(m) - F.col(f"__{m}") for m in metrics}).drop(*[f"__{m}" for m in metrics])


def available(specs: DataFrame, required: str, files: Sequence[str]) -> DataFrame:
    """Specs all of whose required files are there."""
    there = F.array(*map(F.lit, files)) if files else F.array().cast("array<string>")
    return specs.where(F.forall(required, lambda f: F.array_contains(there, f)))


def hours_for(epochs: int, images: int, per_second: Column) -> Column:
    return F.lit(float(epochs * images)) / per_second / 3600.0


def discover(listing: DataFrame, heads: DataFrame) -> DataFrame:
    """Annotation files of a listing (file): JSON objects (file, keys) with images and annotations, with
    the split that their name tells."""
    from ..functions.columns import split_from_path

    both = F.array_contains("keys", "images") & F.array_contains("keys", "annotations")
    return listing.join(heads.where(both).select("file"), "file", "left_semi").withColumn("split", split_from_path(F.col("file")))


def json_keys(spark, folder: str) -> DataFrame:
    """(file, keys) of the JSON objects of a folder; what is no object has no keys."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")).alias("keys"))
