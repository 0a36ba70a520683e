"""Queries that take all rows, against plain versions."""

import math
import os

import pytest

from loomcast.operators import telemetry as T
from loomcast.plans import catalogue

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def folded(rows, tau):
    """{event_id: ema} of (vehicle, t, event_id, depth), one step at a time."""
    out, last = {}, {}
    for vehicle, t, event_id, depth in sorted(rows):
        if vehicle in last:
            before, ema = last[vehicle]
            ema += (1 - math.exp(-(t - before) / tau)) * (depth - ema)
        else:
            ema = depth
        last[vehicle] = t, ema
        out[event_id] = ema
    return out


def test_smoothed_ties(spark):
    rows = [(v, t, i, d) for i, (v, t, d) in enumerate([(25, 0.0, 3.0), (25, 1.0, 8.0), (25, 1.0, 2.0), (25, 1.0, 9.0), (25, 2.5, 4.0), (3, 0.0, 1.0), (3, 0.0, 6.0), (40, 100.0, 7.0)])]
    df = spark.createDataFrame(rows, "vehicle long, t double, event_id long, depth double")
    got = {r.event_id: r.ema for r in T.smoothed(df, "vehicle", "t", "event_id", "depth", 0.8).collect()}
    assert got == pytest.approx(folded(rows, 0.8))


@needs_tables
def test_smoothed_all_vehicles(spark):
    from loomcast.plans.base import telemetry

    rows = [tuple(r) for r in telemetry(spark, SF).select("vehicle", "t", "event_id", "depth").collect()]
    got = {r.event_id: r.ema for r in catalogue.queries()["win_smoothed"](spark, SF).collect()}
    assert len(got) == 10000 and got == pytest.approx(folded(rows, 0.8), abs=2e-5)


def test_overlap_totals(spark):
    from loomcast.operators import joins

    left = [(i, a, a + w) for i, (a, w) in enumerate([(0.0, 3.0), (5.5, 0.0), (8.0, 20.0), (-9.25, 1.0), (40.0, 3.0), (7.0, -1.0)])]
    right = [(1, 0.5, 2.0), (2, 3.0, 3.0), (3, 3.1, 5.5), (4, 8.0, None), (5, -20.0, None), (6, 27.9, 30.0), (7, 6.0, 5.0), (8, -11.0, -9.5), (9, 1.5, 7.9), (10, None, 4.0)]
    meets = lambda a, b, c, d: a <= b and c is not None and (d is None or c <= d) and c <= b and (d is None or d >= a)
    want = {}
    for i, a, b in left:
        hit = [(k, c) for k, c, d in right if meets(a, b, c, d)]
        if hit:
            want[i] = (len(hit), sum(k for k, _ in hit), pytest.approx(sum(max(0.0, a - c) for _, c in hit)))
    lefts = spark.createDataFrame(left, "i long, a double, b double")
    rights = spark.createDataFrame(right, "k long, c double, d double")
    got = joins.overlap_totals(lefts, rights, ("a", "b"), ("c", "d"), "k", 4.0).collect()
    assert {r.i: (r.n, r.total, r.offset) for r in got} == want


@needs_tables
@pytest.mark.parametrize("name, rows", [("join_interval_overlap", 15000), ("retention_policy", 60000)])
def test_all_rows(spark, name, rows):
    from .oracle import compare, connect

    assert compare(catalogue.queries()[name](spark, SF), connect(SF), catalogue.oracle_sql()[name]) > 0.9 * rows


def union_find(edges):
    """{node: the smallest node of its component}."""
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components_hard(spark):
    from loomcast.operators import dedup

    chain = [(i * 7919 % 211, (i + 1) * 7919 % 211) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    edges = chain + star + [(5000, 5000), (6001, 6000), (6000, 6001)]
    got = dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == union_find(edges)


@needs_tables
def test_components_min_label(spark):
    small = SF.replace("sf0.01", "sf0.001")
    edges = [(r.l_orderkey, r.l_partkey + 10000000) for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()]
    got = catalogue.queries()["components_min_label"](spark, small).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == union_find(edges)


@needs_tables
def test_whole_arrays_and_points(spark):
    from .oracle import compare, connect

    con, rows = connect(SF), spark.read.parquet(f"{SF}/embeddings.parquet")
    n, components = rows.count(), rows.selectExpr("sum(size(embedding))").first()[0]
    queries, sql = catalogue.queries(), catalogue.oracle_sql()
    assert {r.n for r in queries["agg_array_explode_sizes"](spark, SF).collect()} == {components}
    assert compare(queries["agg_array_explode_sizes"](spark, SF), con, sql["agg_array_explode_sizes"]) == 4
    assert compare(queries["join_grid_radius"](spark, SF), con, sql["join_grid_radius"]) == n


def test_threshold_search(spark):
    import numpy as np

    from loomcast.operators import metrics

    names = ("dark", "dim", "bright")
    rows = [(round(i * 37 % 101 / 101, 6), None if i % 10 == 0 else names[(i * 37 % 101 > 33) + (i * 37 % 101 > 77)] if i % 7 else "dim") for i in range(300)]
    v, labels = np.array([x for x, y in rows if y]), np.array([y for _, y in rows if y])
    grid, best = np.unique(np.quantile(v, np.linspace(0.01, 0.99, 99))), (-1.0,)
    for i, a in enumerate(grid):
        for b in grid[i:]:
            agreement = float((np.where(v < a, names[0], np.where(v < b, names[1], names[2])) == labels).mean())
            if agreement > best[0]:
                best = agreement, float(a), float(b)
    df, quantiles = spark.createDataFrame(rows, "v double, label string"), [i / 100 for i in range(1, 100)]
    (got,) = metrics.threshold_search(df, "v", "label", names, quantiles).collect()
    assert (got.agreement, got.a, got.b) == pytest.approx(best)
    assert metrics.threshold_search(df.limit(4), "v", "label", names, quantiles).collect() == []


@needs_tables
@pytest.mark.parametrize("name", ["agg_threshold_search", "win_sorted_neighbourhood", "win_rolling_latency", "win_running_median"])
def test_reference_sizes(spark, name):
    from .oracle import compare, connect

    assert compare(catalogue.queries()[name](spark, SF), connect(SF), catalogue.oracle_sql()[name]) > 1
