"""Joins that a plain equality does not say: intervals, latest values, places and vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- intervals


def interval_overlap(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows whose closed ranges overlap: right start <= left end and right end >= left start.

    Both sides are dealt to bins of `width` and joined on the bin (and `on`), so the join is an equi
    join. A pair is kept in the first bin that both share, so it comes once. A null right end is
    open; it reaches as far as the left side does, which one aggregate tells.
    """
    a, b = left_range
    c, d = right_range
    bin_of = lambda x: F.floor(x / F.lit(float(width))).cast("long")
    horizon = left.agg(F.max(b)).first()[0]
    last = F.lit(float(horizon) if horizon is not None else 0.0)
    lefts = left.where(F.col(a) <= F.col(b)).withColumn("__lo", bin_of(F.col(a))).withColumn("__bin", F.explode(F.sequence(F.col("__lo"), bin_of(F.col(b)))))
    end = F.least(F.coalesce(F.col(d), last), last)
    rights = right.where((F.col(c) <= F.coalesce(F.col(d), F.col(c))) & (F.col(c) <= last)).withColumn("__from", bin_of(F.col(c)))
    rights = rights.withColumn("__bin", F.explode(F.sequence(F.col("__from"), F.greatest(F.col("__from"), bin_of(end)))))
    both = lefts.join(rights, [*on, "__bin"])
    meets = (F.col(c) <= F.col(b)) & (F.col(d).isNull() | (F.col(d) >= F.col(a)))
    return both.where(meets & (F.col("__bin") == F.greatest("__lo", "__from"))).drop("__lo", "__from", "__bin")


def overlap_offset(left_start: Column, right_start: Column) -> Column:
    """Where in the right interval the left one begins."""
    return F.greatest(F.lit(0.0), left_start - right_start)


def _upto(values: DataFrame, asked: DataFrame, sums: Sequence[str], width: float, strict: bool) -> DataFrame:
    """(x, sums): for each distinct x of `asked`, the sums of `values` up to x, without x if `strict`.

    Sums are taken within bins of `width` and over bins, so only a row for each bin meets in one task.
    """
    side = F.lit(-1 if strict else 1)
    stacked = values.select("x", *sums, F.lit(0).alias("__side")).unionByName(asked.select("x").distinct().select("x", *[F.lit(0).cast(values.schema[c].dataType).alias(c) for c in sums], side.alias("__side")))
    stacked = stacked.withColumn("__bin", F.floor(F.col("x") / F.lit(float(width))).cast("long"))
    before = Window.partitionBy(F.lit(0)).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = stacked.groupBy("__bin").agg(*[F.sum(c).alias(c) for c in sums])
    bins = bins.select("__bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    within = Window.partitionBy("__bin").orderBy("x", "__side").rowsBetween(Window.unboundedPreceding, 0)
    own = stacked.withColumns({c: F.sum(c).over(within) for c in sums}).where("__side <> 0")
    return own.join(bins, "__bin").select("x", *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in sums])


def overlap_totals(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], value: str, width: float) -> DataFrame:
    """`left` with n, total and offset over the right rows that interval_overlap pairs it with: how many,
    the sum of `value`, and the sum of overlap_offset. Left rows without any are left out.

    Right rows that began by the left end, less those that ended before the left start; no pairs are
    made, so open ranges that meet every later row cost no more than others.
    """
    a, b = left_range
    c, d = right_range
    lefts = left.where(F.col(a) <= F.col(b))
    rights = right.where(F.col(c) <= F.coalesce(F.col(d), F.col(c)))
    sums = ["n", "total", "start"]
    at = lambda df, x: df.groupBy(F.col(x).alias("x")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.sum(F.col(c)).alias("start"))
    began, ended = at(rights, c), at(rights.where(F.col(d).isNotNull()), d)
    ends, starts = lefts.select(F.col(b).alias("x")), lefts.select(F.col(a).alias("x"))
    told = lambda df, tag, key: df.select(F.col("x").alias(key), *[F.col(s).alias(f"__{tag}_{s}") for s in sums])
    out = lefts.join(told(_upto(began, ends, sums, width, False), "b", b), b)
    out = out.join(told(_upto(began, starts, sums, width, False), "a", a), a).join(told(_upto(ended, starts, sums, width, True), "e", a), a)
    offset = F.col(a) * (F.col("__a_n") - F.col("__e_n")) - (F.col("__a_start") - F.col("__e_start"))
    out = out.withColumns({"n": F.col("__b_n") - F.col("__e_n"), "total": F.col("__b_total") - F.col("__e_total"), "offset": offset})
    return out.where("n > 0").select(*left.columns, "n", "total", "offset")


# --------------------------------------------------------------------------- latest values


def latest_fields(samples: DataFrame, key: str, time: str, tie: str, fields: Sequence[str], valid: float) -> DataFrame:
    """The latest value of each field at each sample, null where it is older than `valid`.

    `samples` has for each field a map-like pair of columns <field> and <field>_present: absent keeps
    the value before, present and null clears it.
    """
    upto = Window.partitionBy(key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    out = samples
    for f in fields:
        seen = F.last(F.when(F.col(f"{f}_present"), F.struct(F.col(time).alias("t"), F.col(f).alias("v"))), ignorenulls=True).over(upto)
        out = out.withColumn(f"__{f}", seen)
        out = out.withColumn(f"{f}_now", F.when(F.col(time) - F.col(f"__{f}.t") <= valid, F.col(f"__{f}.v"))).drop(f"__{f}")
    return out


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str, tolerance: float | None = None) -> DataFrame:
    """Each left row with the right value of its key that is latest at its time (`value`_asof).

    Both sides are stacked and the last right value carried on, which is one shuffle on the key and
    no pair of rows. A right value of the same time counts.
    """
    names = left.columns
    lefts = left.select(F.col(key), F.col(time), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.struct(*names).alias("__row"))
    rights = right.select(F.col(key), F.col(time), F.lit(0).alias("__side"), F.col(value).alias("__value"), F.lit(None).cast(left.select(F.struct(*names).alias("x")).schema["x"].dataType).alias("__row"))
    upto = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("__side") == 0, F.struct(F.col(time).alias("t"), F.col("__value").alias("v"))), ignorenulls=True).over(upto)
    out = lefts.unionByName(rights).withColumn("__seen", seen).where("__side = 1")
    fresh = F.col("__seen.v") if tolerance is None else F.when(F.col(time) - F.col("__seen.t") <= tolerance, F.col("__seen.v"))
    return out.select("__row.*", fresh.alias(f"{value}_asof"))


# --------------------------------------------------------------------------- places


def within_radius(left: DataFrame, right: DataFrame, left_xy: tuple[str, str], right_xy: tuple[str, str], radius: float, period: float | None = None) -> DataFrame:
    """Pairs of points at most `radius` apart, with their `distance`; `period` wraps both axes.

    The cells are squares of the radius (with a period, its largest divisor into whole cells); a left
    point looks into its cell and the eight around it.
    """
    cells = int(period // radius) if period else None
    if cells is not None and cells < 3:
        raise ValueError("the period must hold three cells")
    side = period / cells if period else radius
    cell = lambda v: F.floor((F.pmod(v, F.lit(float(period))) if period else v) / F.lit(float(side))).cast("long")
    wrap = lambda c: F.pmod(c, F.lit(cells)) if cells else c
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    lefts = left.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
    lefts = lefts.withColumns({"__cx": wrap(cell(F.col(left_xy[0])) + F.col("__dx")), "__cy": wrap(cell(F.col(left_xy[1])) + F.col("__dy"))}).drop("__dx", "__dy")
    rights = right.withColumns({"__cx": wrap(cell(F.col(right_xy[0]))), "__cy": wrap(cell(F.col(right_xy[1])))})

    def apart(a: str, b: str) -> Column:
        d = F.col(a) - F.col(b)
        if not period:
            return d
        return F.pmod(d + period / 2.0, F.lit(float(period))) - period / 2.0

    distance = F.hypot(apart(left_xy[0], right_xy[0]), apart(left_xy[1], right_xy[1]))
    return lefts.join(rights, ["__cx", "__cy"]).withColumn("distance", distance).where(F.col("distance") <= radius).drop("__cx", "__cy")


# --------------------------------------------------------------------------- vectors


def nearest_remembered(queries: DataFrame, memory: DataFrame, id_col: str, vector: str, limit: int = 512) -> DataFrame:
    """(id, nearest_id, similarity): the most similar of at most `limit` remembered vectors.

    The memory is bounded by its definition (the latest animals); more rows are an error and are not
    dropped in silence. Equal similarities go to the smaller id; without memory there is no match.
    """
    rows = memory.select(id_col, vector).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the memory holds more than {limit} vectors")
    rows.sort(key=lambda r: r[0])
    names = [int(r[0]) for r in rows]
    matrix = np.array([r[1] for r in rows], dtype=np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300) if len(rows) else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            if not len(x):
                continue
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            if names:
                similar = x @ matrix.T
                best = similar.argmax(axis=1)
                found = pa.array([names[i] for i in best], pa.int64()), pa.array(similar[np.arange(len(x)), best])
            else:
                found = pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *found], names=["id", "nearest_id", "similarity"])

    return queries.select(id_col, vector).mapInArrow(run, "id long, nearest_id long, similarity double")


# --------------------------------------------------------------------------- outcomes


def three_way(parents: DataFrame, children: DataFrame, clips: DataFrame, key: str, clip: str, completed: str) -> DataFrame:
    """Parents with an `outcome`: `boxed` with children; without, `empty` if their clip was completed
    and `dropped` if it was not or is not listed."""
    boxed = children.select(key).distinct().withColumn("__boxed", F.lit(True))
    listed = clips.select(clip, F.col(completed).alias("__completed"))
    out = parents.join(boxed, key, "left").join(listed, clip, "left")
    outcome = F.when(F.col("__completed").isNull(), "dropped").when(F.coalesce("__boxed", F.lit(False)), "boxed").when(F.col("__completed"), "empty").otherwise("dropped")
    return out.withColumn("outcome", outcome).drop("__boxed", "__completed")


def pick_near(found: DataFrame, keys: list[str], x: str, y: str, mass: str, tie: str, at: tuple[Column, Column] | None = None, gate: float = 0.35) -> DataFrame:
    """One of the places `found` of each key: the nearest to `at` within `gate`, else the heaviest; of
    equals the first by `tie`. One aggregate, as the order of preference is one value."""
    rows = found
    if at is None:
        worth = F.struct(F.lit(0).alias("near"), F.lit(0.0).alias("off"), F.col(mass).alias("mass"), (-F.col(tie)).alias("tie"))
    else:
        off = F.hypot(F.col(x) - at[0], F.col(y) - at[1])
        near = off <= gate
        worth = F.struct(near.cast("int").alias("near"), F.when(near, -off).otherwise(0.0).alias("off"), F.when(near, 0.0).otherwise(F.col(mass)).alias("mass"), (-F.col(tie)).alias("tie"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(tie, x, y, mass), worth).alias("__p")).select(*keys, "__p.*")
