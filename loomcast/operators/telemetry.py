"""Ordered operators over telemetry: durations, sessions, rolling counts, decay, reports.

All work by key (a vehicle), with one shuffle for the key and one sort within it; operators that
take the same key and order share both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .planner import posterior_rate


def _order(key: str, *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def step_seconds(key: str, time: str, tie: str, most: float = 1.0) -> Column:
    """Seconds to the next row of the key, at most `most`; 0 at the last."""
    ahead = F.lead(time).over(_order(key, time, tie))
    return F.when(ahead.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), ahead - F.col(time))))


def state_seconds(df: DataFrame, state: str, dt: str) -> DataFrame:
    """(state, seconds, share) over all rows."""
    sums = df.groupBy(F.col(state).alias("state")).agg(F.sum(dt).alias("seconds"))
    total = sums.agg(F.sum("seconds").alias("total"))
    return sums.join(F.broadcast(total)).select("state", "seconds", F.coalesce(F.try_divide("seconds", "total"), F.lit(0.0)).alias("share"))


def band(depth: Column, width: float) -> Column:
    return F.floor(depth / F.lit(float(width))) * F.lit(float(width))


def band_rates(df: DataFrame, searching: Column, found: Column, depth: str, dt: str, width: float) -> DataFrame:
    """(band, seconds, finds, per_minute) of search by depth band; rows without depth are left out."""
    rows = df.where(searching & F.col(depth).isNotNull())
    out = rows.groupBy(band(F.col(depth), width).alias("band")).agg(F.sum(dt).alias("seconds"), F.count_if(found).alias("finds"))
    return out.withColumn("per_minute", F.when(F.col("seconds") > 0, F.col("finds") / (F.col("seconds") / 60.0)))


def band_temperature(df: DataFrame, depth: str, temperature: str, width: float) -> DataFrame:
    """(band, median_temp, samples)."""
    rows = df.where(F.col(depth).isNotNull() & F.col(temperature).isNotNull())
    return rows.groupBy(band(F.col(depth), width).alias("band")).agg(F.median(temperature).alias("median_temp"), F.count("*").alias("samples"))


def thermocline(bands: DataFrame, least: float = 0.5) -> DataFrame:
    """The steepest step between observed bands that follow each other (upper, lower, step), if it is
    at least `least`; the deeper of equal ones. Bands are few."""
    order = Window.partitionBy(F.lit(0)).orderBy("band")
    steps = bands.select(F.lag("band").over(order).alias("upper"), F.col("band").alias("lower"), F.abs(F.col("median_temp") - F.lag("median_temp").over(order)).alias("step"))
    return steps.where(F.col("upper").isNotNull() & (F.col("step") >= least)).orderBy(F.col("step").desc(), F.col("upper").desc()).limit(1)


def sessions(df: DataFrame, key: str, time: str, tie: str, active: Column) -> DataFrame:
    """`df` with session, the number of the stretch of active rows a row is in, null outside; a session
    begins where an active row follows an inactive one or none."""
    w = _order(key, time, tie)
    marked = df.withColumn("__on", F.coalesce(active, F.lit(False)))
    starts = marked.withColumn("__start", F.col("__on") & ~F.coalesce(F.lag("__on").over(w), F.lit(False)))
    number = F.sum(F.col("__start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return starts.withColumn("session", F.when(F.col("__on"), number)).drop("__on", "__start")


def look_sessions(df: DataFrame, key: str, time: str, tie: str, looking: Column, cue: str, found: Column) -> DataFrame:
    """(cue, looks, finds): looks by what set them off, and how many ended in a find on the row after a
    looking one. A look takes the cue of its first row, '?' without."""
    w = _order(key, time, tie)
    rows = sessions(df, key, time, tie, looking).withColumn("__found", found)
    open_ = F.last("session", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"__after": F.lag("session").over(w), "__open": open_})
    first = rows.where("session is not null").groupBy(key, "session").agg(F.min_by(F.coalesce(F.col(cue), F.lit("?")), F.struct(time, tie)).alias("cue"))
    ended = rows.where(F.col("__after").isNotNull() & F.col("__found")).select(key, F.col("__after").alias("session")).distinct().withColumn("__hit", F.lit(1))
    return first.join(ended, [key, "session"], "left").groupBy("cue").agg(F.count("*").alias("looks"), F.count("__hit").alias("finds"))


def idle_sessions(df: DataFrame, key: str, time: str, tie: str, gap: float) -> DataFrame:
    """`df` with session: a row more than `gap` after the one before begins a new one."""
    w = _order(key, time, tie)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def n_of_m(key: str, time: str, tie: str, hit: Column, n: int, m: int) -> Column:
    """Whether at least n of the last m rows are hits."""
    return F.sum(hit.cast("int")).over(_order(key, time, tie).rowsBetween(-(m - 1), 0)) >= n


def onset(key: str, time: str, tie: str, hit: Column, quiet: float) -> Column:
    """A hit with no other one within `quiet` before it."""
    last = F.max(F.when(hit, F.col(time))).over(_order(key, time, tie).rowsBetween(Window.unboundedPreceding, -1))
    return hit & F.coalesce(F.col(time) - last > quiet, F.lit(True))


def decayed_rates(df: DataFrame, key: str, time: str, dt: str, find: Column, group: Column, half_life: float) -> DataFrame:
    """(key, band, exposure, events, per_minute): sums that halve every `half_life`, at the last time of
    the key, in closed form, and the rate with a prior."""
    last = df.groupBy(key).agg(F.max(time).alias("__last"))
    fade = F.pow(F.lit(0.5), (F.col("__last") - F.col(time)) / F.lit(float(half_life)))
    rows = df.join(last, key).withColumns({"band": group, "__fade": fade, "__find": find.cast("int")})
    out = rows.groupBy(key, "band").agg(F.sum(F.col(dt) * F.col("__fade")).alias("exposure"), F.sum(F.col("__find") * F.col("__fade")).alias("events"))
    return out.withColumn("per_minute", posterior_rate(F.col("events"), F.col("exposure")))


def debounced(df: DataFrame, key: str, time: str, tie: str, raw: str, hold: float) -> DataFrame:
    """`df` with stable: the raw value once it has been the same for `hold`, else null."""
    w = _order(key, time, tie)
    change = F.coalesce((F.lag(raw).over(w) != F.col(raw)).cast("int"), F.lit(1))
    island = df.withColumn("__c", change).withColumn("__i", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.min(time).over(Window.partitionBy(key, "__i"))
    return island.withColumn("__since", since).withColumn("stable", F.when(F.col(time) - F.col("__since") >= hold, F.col(raw))).drop("__c", "__i", "__since")


def best_row(df: DataFrame, keys: Sequence[str], score: Column, time: str, tie: str) -> DataFrame:
    """(keys, best_t, best_score): the time of the largest score, the first of equals."""
    return df.groupBy(*keys).agg(F.min_by(time, F.struct(-score, F.col(time), F.col(tie))).alias("best_t"), F.max(score).alias("best_score"))


def over_median(df: DataFrame, key: str, time: str, tie: str, value: str, history: int = 200, least: int = 10) -> DataFrame:
    """Rows with novelty, their value over the median of up to `history` values before; rows with fewer
    than `least` values before, or with a median that is not above 0, are left out."""
    w = _order(key, time, tie).rowsBetween(-history, -1)
    rows = df.withColumns({"__m": F.percentile(value, 0.5).over(w), "__n": F.count(value).over(w)})
    return rows.where((F.col("__n") >= least) & (F.col("__m") > 0)).withColumn("novelty", F.col(value) / F.col("__m")).drop("__m", "__n")


def smoothed(df: DataFrame, key: str, time: str, tie: str, value: str, tau: float) -> DataFrame:
    """`df` with ema, x += (1 - exp(-dt / tau)) (value - x), from the first value on.

    One pass over the rows of each key in order, with nothing kept but the last time and value. Rows of
    one time follow each other with no time between; a row without a value or time has no ema.
    """
    schema = T.StructType([*df.schema, T.StructField("ema", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before, x = object(), 0.0, 0.0
        for batch in batches:
            out: list[float | None] = []
            for k, t, v in zip(*(batch.column(c).to_pylist() for c in (key, time, value))):
                if t is None or v is None:
                    out.append(None)
                    continue
                x = float(v) if k != own else x - math.expm1(-(t - before) / tau) * (v - x)
                own, before = k, t
                out.append(x)
            yield batch.append_column("ema", pa.array(out, pa.float64()))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(key, time, tie).mapInArrow(run, schema)


def rolling_percentiles(df: DataFrame, key: str, time: str, tie: str, value: str, rows: int, quantiles: Sequence[float]) -> DataFrame:
    """`df` with rolling, the exact percentiles of the last `rows` values, this one included."""
    w = _order(key, time, tie).rowsBetween(-(rows - 1), 0)
    return df.withColumn("rolling", F.percentile(value, [float(q) for q in quantiles]).over(w))


def sorted_neighbourhood(df: DataFrame, key: str, order: str, id_col: str, reach: int) -> DataFrame:
    """(key, a, b) of rows at most `reach` places apart within a key, by `order` and id.

    The next `reach` ids are gathered by a window and exploded, so the pairs of a key are its rows
    times the reach.
    """
    w = Window.partitionBy(key).orderBy(order, id_col).rowsBetween(1, reach)
    near = df.select(key, F.col(id_col).alias("a"), F.collect_list(id_col).over(w).alias("near"))
    return near.select(key, "a", F.explode("near").alias("b"))


def retention(df: DataFrame, key: str, start: str, size: str, end: str, keep: Column, free: float, wanted: float, protected: float) -> DataFrame:
    """`df` with delete: the oldest closed, unprotected and unkept segments, until enough is free."""
    open_ = F.coalesce((F.col(end) < protected) & ~keep, F.lit(False))
    before = Window.partitionBy(key).orderBy(start, size).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.when(F.col("__open"), F.col(size)).otherwise(0)).over(before), F.lit(0))
    return df.withColumn("__open", open_).withColumn("delete", F.col("__open") & (F.lit(float(free)) + gone < wanted)).drop("__open")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.coalesce(F.try_divide(F.sum(value * weight), F.sum(weight)), F.lit(0.0))


def mission(key: str, time: str, tie: str, start: Column) -> Column:
    """The number of the mission a row belongs to: starts up to it."""
    return F.sum(start.cast("int")).over(_order(key, time, tie).rowsBetween(Window.unboundedPreceding, 0))


def stalled(df: DataFrame, key: str, time: str, tie: str, distance: str, step: float = 1.0, seconds: float = 60.0) -> DataFrame:
    """`df` with stalled: no new best distance, by at least `step`, for more than `seconds`. A best counts
    in whole steps from the first distance on."""
    w = _order(key, time, tie)
    level = F.floor((F.first(distance).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.min(distance).over(w.rowsBetween(Window.unboundedPreceding, 0))) / step)
    leveled = df.withColumn("__level", level)
    since = F.min(time).over(Window.partitionBy(key, "__level"))
    return leveled.withColumn("__since", since).withColumn("stalled", F.col(time) - F.col("__since") > seconds).drop("__level", "__since")


def repeated_near(df: DataFrame, key: str, time: str, tie: str, x: str, y: str, rows: int = 3, need: int = 2, near: float = 0.15) -> DataFrame:
    """`df` with repeated: of this and the rows before, `rows` in all, at least `need` have a place within
    `near` of this one's."""
    w = _order(key, time, tie).rowsBetween(-(rows - 1), 0)
    places = F.collect_list(F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).over(w)
    close = F.size(F.filter("__places", lambda p: F.hypot(p["x"] - F.col(x), p["y"] - F.col(y)) <= near))
    return df.withColumn("__places", places).withColumn("repeated", F.col(x).isNotNull() & (close >= need)).drop("__places")


def sampled_mean(df: DataFrame, key: str, time: str, tie: str, value: str, rows: int = 50, every: float = 5.0) -> DataFrame:
    """(key, time, mean): the mean of the last `rows` values at the first row of each stretch of `every`."""
    w = _order(key, time, tie)
    slot = F.floor(F.col(time) / every)
    out = df.withColumns({"mean": F.avg(value).over(w.rowsBetween(-(rows - 1), 0)), "__new": F.coalesce(slot != F.lag(slot).over(w), F.lit(True))})
    return out.where("__new").select(key, time, "mean")
