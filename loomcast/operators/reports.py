"""Reports of evaluations, of variants and of speed, and the log of a run's measures."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import markdown
from . import experiments

BLOCKS = ("all", "dark", "murky", "clear")


def _number(c: str, digits: int = 3) -> F.Column:
    return F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), "–").otherwise(F.format_string(f"%.{digits}f", F.col(c).cast("double")))


def _interval() -> F.Column:
    """A measure with its interval, if it has one, and how many rows it is of."""
    known = F.col("low").isNotNull() & ~F.isnan("low")
    return F.concat(_number("auc"), F.when(known, F.format_string(" [%.2f, %.2f]", "low", "high")).otherwise(""), F.format_string(" (n=%d)", "n"))


def _spread(rows: DataFrame, keys: Sequence[str], cell: F.Column, names: Sequence[str]) -> DataFrame:
    """A column for each block; a block that is not there is a dash."""
    return rows.select(*keys, "block", cell.alias("__cell")).groupBy(*keys).pivot("block", list(names)).agg(F.first("__cell")).na.fill("–")


def evaluation(frames: DataFrame, heats: DataFrame, costs: DataFrame | None = None, robustness: DataFrame | None = None) -> str:
    """The Markdown report of frozen backbones, by input size.

    frames is (backbone, input, block, n, auc, low, high, tpr), heats (backbone, input, block) with the
    measures of probes.heat_blocks, costs (model, params_m, gmacs, fps) and robustness (backbone, input,
    operation, level, auc). Blocks that begin with `source:` are told in a table of their own.
    """
    out = ["# Evaluation report", "", "Frozen features; probes are fitted on train, their weight decay is chosen on val, results are on test.", ""]
    for size in sorted(r[0] for r in frames.select("input").distinct().collect()):
        own = frames.where(F.col("input") == size)
        told = _spread(own.where(F.col("block").isin(*BLOCKS)), ["backbone"], _interval(), BLOCKS)
        tpr = own.where("block = 'all'").select("backbone", _number("tpr").alias("TPR at 5 % FPR"))
        out += [f"## Input {size}", "", "### Frames (AUROC)", "", markdown(told.join(tpr, "backbone", "left"), order=["backbone"])]
        heat = heats.where(F.col("input") == size)
        slashed = lambda c: F.array_join(F.transform(F.array(*map(F.lit, BLOCKS)), lambda b: F.coalesce(F.element_at(c, b), F.lit("–"))), " / ")
        maps = heat.groupBy("backbone").agg(*[F.map_from_entries(F.collect_list(F.struct("block", _number(c)))).alias(c) for c in ("patch_auc", "error_median")])
        whole = heat.where("block = 'all'").select("backbone", *[_number(c).alias(c) for c in ("within_auc", "error_p90", "size_error", "hit_rate", "found")])
        steering = maps.select("backbone", slashed(F.col("patch_auc")).alias("patch AUROC (all / dark / murky / clear)"), slashed(F.col("error_median")).alias("centroid error °")).join(whole, "backbone", "left")
        out += ["### Patches and steering", "", markdown(steering, order=["backbone"])]
        sources = own.where(F.startswith("block", F.lit("source:"))).withColumn("block", F.substring("block", 8, 1000))
        names = sorted(r[0] for r in sources.select("block").distinct().collect())
        if names:
            out += ["### Frames by source (AUROC)", "", markdown(_spread(sources, ["backbone"], _number("auc"), names), order=["backbone"])]
        if costs is not None:
            priced = experiments.with_costs(own.select("backbone", "input").distinct(), costs, ["backbone", "input"])
            out += ["### Cost", "", markdown(priced, order=["backbone"])]
        if robustness is not None:
            rows = robustness.where(F.col("input") == size).withColumns({"block": F.col("level").cast("string")})
            levels = sorted({r[0] for r in rows.select("block").distinct().collect()}, key=int)
            if levels:
                out += ["### Synthetic degradations (frame AUROC by severity)", "", markdown(_spread(rows, ["backbone", "operation"], _number("auc"), levels), order=["backbone", "operation"])]
    return "\n".join(out)


def parity(results: DataFrame, reference: str, most_auc: float = 0.01, most_degrees: float = 1.0) -> str:
    """Variants (runner, auc, centroid_deg) against the reference runner, and which of them pass."""
    from .metrics import within_tolerance

    told = experiments.against(results, "runner", reference, [], ["auc", "centroid_deg"])
    verdict = F.when(within_tolerance(F.col("delta_auc"), F.col("delta_centroid_deg"), most_auc, most_degrees), "pass").otherwise("FAIL")
    shown = told.select("runner", *[_number(c, 4).alias(c) for c in ("auc", "delta_auc", "centroid_deg", "delta_centroid_deg")], verdict.alias("verdict"))
    return "\n".join(["# Parity report", "", f"Reference: {reference}.", "", markdown(shown, order=["runner"])])


def speed(rows: DataFrame) -> str:
    """Latencies (model, runtime, threads, ms, error): one line for each setting, and what failed."""
    ok = rows.where("error is null")
    told = experiments.latency(ok, ["model", "runtime", "threads"], "ms")
    shown = told.select("model", "runtime", "threads", "n", *[_number(c, 2).alias(c) for c in ("mean", "p50", "p90", "p99", "fps")])
    failed = rows.where("error is not null").groupBy("model", "runtime", "threads").agg(F.first("error").alias("error"))
    out = ["# Speed report", "", markdown(shown, order=["model", "runtime", "threads"])]
    if failed.limit(1).count():
        out += ["## Failed", "", markdown(failed, order=["model", "runtime", "threads"])]
    return "\n".join(out)


class MetricLog:
    """Appends a JSON line for each step's measures to a folder that Spark can write to; `read` gives
    them back as (step, name, value). What is no number is kept as text and left out of `read`."""

    def __init__(self, spark: SparkSession, path: str, enabled: bool = True):
        self.spark, self.path, self.enabled = spark, path, enabled

    def log(self, step: int, measures: Mapping[str, object]) -> None:
        if self.enabled and measures:
            clean = {k: float(v) if hasattr(v, "__float__") else str(v) for k, v in measures.items()}
            line = json.dumps({"step": step, "time": time.time(), "measures": json.dumps(clean)})
            self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(self.path)

    def read(self) -> DataFrame:
        rows = self.spark.read.schema("step LONG, time DOUBLE, measures STRING").json(self.path)
        each = rows.select("step", F.explode(F.from_json("measures", "map<string,string>")).alias("name", "text"))
        return each.select("step", "name", F.col("text").try_cast("double").alias("value")).where("value is not null")
