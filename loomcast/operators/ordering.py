"""Totals along an order of all rows, without one task that sees them all.

Rows are dealt to ranges of the order, which is written down once so that the ranges stay what they
are; sums run within a range, and one row for each range tells what comes before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize


def in_ranges(df: DataFrame, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """`df` with __range, ascending along `order`; rows of equal order share one."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def totals_before(df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """`df` with a column for each of `sums`: the total over the rows before this one, within `by`.

    The order has to be that of all rows: `by` counts as its first columns, and no two rows of `by` may
    be equal in it.
    """
    keys = list(by)
    rows = in_ranges(df, [*map(F.col, keys), *order], ranges)
    values = {f"__v{i}": c for i, c in enumerate(sums.values())}
    rows = rows.withColumns(values)
    within = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = rows.groupBy("__range", *keys).agg(*[F.sum(v).alias(v) for v in values])
    parts = parts.select(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[zero(F.sum(v).over(across)).alias(f"__b{i}") for i, v in enumerate(values)])
    own = rows.withColumns({f"__o{i}": zero(F.sum(v).over(within)) for i, v in enumerate(values)})
    match = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    made = [(F.col(f"__o{i}") + F.col(f"__b{i}")).alias(name) for i, name in enumerate(sums)]
    return own.join(parts, match).select(*df.columns, *made)
