"""The report of a dive, from its frames and encounters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.writers import markdown
from . import telemetry as T

BEFORE, SEARCHING = ("SAFE", "ARMED"), ("SEARCH", "ACQUIRE")


def timed(frames: DataFrame) -> DataFrame:
    """Frames (readers.FRAME) of one dive with dt; a gap counts a second at most."""
    return frames.withColumn("__dive", F.lit(0)).withColumn("dt", T.step_seconds("__dive", "t", "frame" if "frame" in frames.columns else "t"))


def mission(frames: DataFrame) -> DataFrame:
    """(frames, minutes, outside_minutes, mission_hours, missions); rates are per hour of mission."""
    outside = F.sum(F.when(F.col("state").isin(*BEFORE), F.col("dt")).otherwise(0.0))
    span = F.greatest(F.max("t") - F.min("t"), F.lit(1e-9))
    starts = F.count_if(F.array_contains(F.coalesce("events", F.array().cast("array<string>")), "mission_start"))
    return frames.agg(F.count("*").alias("frames"), (span / 60).alias("minutes"), (outside / 60).alias("outside_minutes"), F.greatest(span / 3600 - outside / 3600, F.lit(1e-9)).alias("mission_hours"), starts.alias("missions"))


def found() -> F.Column:
    return F.coalesce(F.array_contains("events", "state:ACQUIRE"), F.lit(False))


def by_reason(encounters: DataFrame, column: str) -> DataFrame:
    return encounters.groupBy(F.coalesce(column, F.lit("?")).alias(column)).agg(F.count("*").alias("encounters"), F.median(F.coalesce("engaged_s", F.lit(0.0))).alias("median_engaged_s"), F.median(F.coalesce("good_s", F.lit(0.0))).alias("median_good_s"))


def spread(df: DataFrame, column: str) -> DataFrame:
    q = F.percentile(column, F.array(*map(F.lit, (0.05, 0.5, 0.95))))
    return df.agg(q.alias("q")).select(*[F.col("q")[i].alias(n) for i, n in enumerate(("p5", "p50", "p95"))])


def report(frames: DataFrame, encounters: DataFrame, band_m: float = 10.0) -> str:
    if not frames.limit(1).count():
        return "No guidance telemetry found."
    rows = timed(frames).cache()
    depth = rows.withColumns({"depth": F.col("nav.depth_m"), "temp": F.col("nav.temp_c")})
    out = ["# Dive report", "", markdown(mission(rows)), "## Time per state", "", markdown(T.state_seconds(rows, "state", "dt").orderBy(F.desc("seconds")))]
    bands = T.band_rates(depth, F.col("state").isin(*SEARCHING), found(), "depth", "dt", band_m)
    out += ["## Search by depth", "", markdown(bands, order=["band"])]
    temperature = T.band_temperature(depth, "depth", "temp", band_m)
    step = T.thermocline(temperature).first()
    out += ["## Temperature by depth", "", markdown(temperature, order=["band"])]
    if step:
        out += [f"Steepest change: {step.step:.1f} °C between {step.upper:.0f}–{step.upper + band_m:.0f} m and {step.lower:.0f}–{step.lower + band_m:.0f} m.", ""]
    looks = T.look_sessions(rows.withColumns({"cue": F.col("curiosity.cue"), "n": F.monotonically_increasing_id()}), "__dive", "t", "n", F.coalesce("curiosity.looking", F.lit(False)), "cue", found())
    out += ["## Looks", "", markdown(looks, order=["cue"])]
    hours = mission(rows).first().mission_hours
    value = encounters.agg(F.sum(F.coalesce("value", F.lit(0.0)))).first()[0] or 0.0
    out += ["## Encounters", "", f"Footage value {value:.2f}, {value / hours:.2f} per hour.", "", markdown(by_reason(encounters, "reason").orderBy(F.desc("encounters"), "reason")), markdown(by_reason(encounters, "behaviour").orderBy(F.desc("encounters"), "behaviour")), markdown(spread(encounters, "novelty_weight"))]
    lamp = rows.agg(T.weighted_mean(F.coalesce("cmd.light", F.lit(0.0)), F.col("dt")).alias("lamp"), T.weighted_mean(F.coalesce("lights.dark", F.lit(False)).cast("double"), F.col("dt")).alias("dark"), F.count_if(F.coalesce("reid.skipped", F.lit(0)) > 0).alias("skipped"))
    out += ["## Calibration", "", markdown(lamp), markdown(spread(rows, "reid.sim")), markdown(spread(rows, "lights.ambient"))]
    rows.unpersist()
    return "\n".join(out)
