"""The registered queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arrays, curation, evaluation, ordered, rows, streams

ALL = {**curation.QUERIES, **ordered.QUERIES, **evaluation.QUERIES, **streams.QUERIES, **arrays.QUERIES, **rows.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in ALL.items() if q.sql is not None}
