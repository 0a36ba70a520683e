import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.functions import columns as C
from loomcast.operators import dedup, joins, metrics, sampling, telemetry


def test_hamming_pairs_equal_all_pairs(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(30)]
    rows = []
    for i in range(300):
        h = r.choice(base)
        for _ in range(r.randrange(8)):
            h ^= 1 << r.randrange(64)
        rows.append((i, h - (1 << 64) if h >> 63 else h))
    rows += [(300, None), (301, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, h long")
    least = {}
    for i, h in rows:
        if h is not None:
            least[h] = min(least.get(h, i), i)
    nodes = sorted((i, h) for h, i in least.items())
    distance = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    want = {(a, b, distance(x, y)) for a, x in nodes for b, y in nodes if a < b and distance(x, y) <= 6}
    assert {tuple(p) for p in dedup.hamming_pairs(df, "id", "h", 6).collect()} == want and want
    clusters = {r.id: r.dup_cluster for r in dedup.near_duplicate_clusters(df, "id", "h").collect()}
    assert clusters[301] == clusters[rows[0][0]] and clusters[300] == 300


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = {r.node: r.component for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), **dict.fromkeys(range(100, 120), 100)}


def survivors(spark, rows):
    df = spark.createDataFrame(rows, "id long, dup_cluster long, split string, mask string, boxes int, label int, area int")
    out = dedup.survivors(df, "id", C.richness(F.col("mask"), F.col("boxes"), F.col("label")), F.col("area"))
    return {r.id: r.removed_reason for r in out.collect()}


def test_survivors(spark):
    assert survivors(spark, [(1, 1, "test", "m", 0, -1, 1), (2, 1, "train", None, 0, -1, 1), (3, 3, "train", None, 0, -1, 1)]) == {1: None, 2: "dup_of_eval", 3: None}
    got = survivors(spark, [(1, 1, "train", "", 1, 1, 9), (2, 1, "train", "m", 0, -1, 1), (3, 1, "train", "m", 0, -1, 2), (4, 1, "train", "m", 0, -1, 2)])
    assert got == {1: "near_dup", 2: "near_dup", 3: None, 4: "near_dup"}
    got = survivors(spark, [(1, 1, "val", "m", 1, 1, 9), (2, 1, "val", None, 0, 0, 1), (3, 1, "test", None, 0, -1, 1), (4, 1, "test", None, 0, -1, 2)])
    assert got == {1: "dup_of_test", 2: "dup_of_test", 3: "near_dup", 4: None}


def test_interval_overlap(spark):
    left = spark.createDataFrame([(1, 8.0, 12.0), (2, 30.0, 30.0), (3, 5.0, 4.0)], "e int, a double, b double")
    right = spark.createDataFrame([("x", 0.0, 10.0), ("y", 10.0, 20.0), ("z", 20.0, None), ("w", 12.5, 13.0)], "file string, c double, d double")
    out = joins.interval_overlap(left, right, ("a", "b"), ("c", "d"), 3.0).withColumn("o", joins.overlap_offset(F.col("a"), F.col("c")))
    assert sorted((r.e, r.file, r.o) for r in out.collect()) == [(1, "x", 8.0), (1, "y", 0.0), (2, "z", 10.0)]


def test_radius_on_a_wrapped_plane(spark):
    r = random.Random(2)
    rows = [(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(120)]
    a = spark.createDataFrame(rows[:40], "i int, x double, y double")
    b = spark.createDataFrame(rows, "j int, u double, v double")
    got = {(p.i, p.j) for p in joins.within_radius(a, b, ("x", "y"), ("u", "v"), 9.0, 100.0).collect()}
    near = lambda p, q: min(abs(p - q), 100 - abs(p - q))
    assert got == {(i, j) for i, x, y in rows[:40] for j, u, v in rows if near(x, u) ** 2 + near(y, v) ** 2 <= 81}


def test_latest_fields(spark):
    rows = [(1, 0.0, 5.0, True), (2, 1.0, None, False), (3, 1.4, None, True), (4, 1.5, 7.0, True), (5, 3.2, None, False)]
    df = spark.createDataFrame([("k", n, t, v, p) for n, t, v, p in rows], "k string, n int, t double, depth double, depth_present boolean")
    got = [r.depth_now for r in joins.latest_fields(df, "k", "t", "n", ["depth"], 1.5).orderBy("n").collect()]
    assert got == [5.0, 5.0, None, 7.0, None]


def test_asof(spark):
    left = spark.createDataFrame([("k", 1.0, "a"), ("k", 5.0, "b"), ("m", 1.0, "c")], "k string, t double, n string")
    right = spark.createDataFrame([("k", 1.0, 10), ("k", 2.0, 20)], "k string, t double, v int")
    assert {r.n: r.v_asof for r in joins.asof_join(left, right, "k", "t", "v", 2.5).collect()} == {"a": 10, "b": None, "c": None}


def test_nearest_refuses_an_unbounded_memory(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, v array<double>")
    with pytest.raises(ValueError):
        joins.nearest_remembered(df, df, "id", "v", 4)
    assert {r.nearest_id for r in joins.nearest_remembered(df, df.limit(0), "id", "v").collect()} == {None}


def test_source_multipliers():
    sums = {"a": 80.0, "b": 10.0, "": 10.0}
    out = sampling.source_multipliers(sums, {"a": 0.5, "b": 0.2})
    now = {s: w * out.get(s, 1.0) for s, w in sums.items()}
    total = sum(now.values())
    assert now["a"] / total <= 0.5 + 1e-3 and now["b"] / total <= 0.2 + 0.1 and now[""] == 10.0
    assert sampling.source_multipliers({"a": 5.0}, {"a": 0.1}) == {"a": 1.0}


def test_weights_have_mean_one(spark):
    df = spark.createDataFrame([(i, "train" if i % 5 else "val", "x" if i < 30 else "y", "b" if i % 7 else "c") for i in range(100)], "id int, split string, source string, bucket string")
    raw = sampling.bucket_weights(df, F.col("split") == "train", F.col("bucket"))
    out = sampling.source_capped_weights(raw, F.col("split") == "train", "source", {"x": 0.2}).collect()
    train = [r.weight for r in out if r.split == "train"]
    assert np.mean(train) == pytest.approx(1.0) and {r.weight for r in out if r.split == "val"} == {0.0}
    assert sum(r.weight for r in out if r.source == "x") / sum(train) == pytest.approx(0.2)


def test_draws(spark):
    df = spark.createDataFrame([(i, 90.0 if i == 7 else 1.0 if i % 2 else 0.0) for i in range(21)], "id long, w double")
    draws = {r.draw: r.id for r in sampling.weighted_draws(df, "id", "w", 100, 0).collect()}
    assert len(draws) == 100 and sum(v == 7 for v in draws.values()) > 80 and all(v % 2 for v in draws.values())
    shards = [{r.draw: r.id for r in sampling.weighted_draws(df, "id", "w", 100, 0, rank=k, world=2).collect()} for k in (0, 1)]
    assert shards[0] | shards[1] == draws and not set(shards[0]) & set(shards[1])
    assert {r.draw: r.id for r in sampling.weighted_draws(df, "id", "w", 100, 0, start=10).collect()} == {k: v for k, v in draws.items() if k >= 10}


def test_row_order_does_not_matter(spark):
    rows = [(i, f"g{i % 3}") for i in range(60)]
    pick = lambda data: {r.id for r in sampling.cap_per_group(spark.createDataFrame(data, "id long, g string"), ["g"], C.hash01(0, "cap", F.col("id")), "id", 4).collect()}
    assert pick(rows) == pick(rows[::-1]) and len(pick(rows)) == 12


def scores(spark, rows):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(rows)], "id int, y int, s double")


def test_ranking_metrics(spark):
    df = scores(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    assert metrics.roc_auc(df, "y", "s").first().auc == 0.75
    assert metrics.average_precision(df, "y", "s", "id").first().ap == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.roc_auc(scores(spark, [(0, 1), (1, 1), (0, 1)]), "y", "s").first().auc == 0.5
    assert np.isnan(metrics.roc_auc(scores(spark, [(1, 1), (1, 2)]), "y", "s").first().auc)
    many = scores(spark, [(0, x) for x in np.linspace(0, 1, 100)] + [(1, 2.0)] * 10)
    assert metrics.tpr_at_fpr(many, "y", "s", 0.05).first().tpr == 1.0
    best = metrics.best_iou(scores(spark, [(1, 0.9), (1, 0.6), (0, 0.55), (0, 0.2)]), "y", "s").first()
    assert best.best_iou == 1.0 and best.best_threshold == 0.6
    none = metrics.best_iou(scores(spark, [(1, 0.01)]), "y", "s").first()
    assert (none.best_iou, none.best_threshold) == (0.0, 0.5)


def test_bootstrap(spark):
    df = scores(spark, [(i % 2, (i % 2) * 0.5 + i * 0.004) for i in range(120)]).withColumn("g", F.lit("a"))
    first = metrics.bootstrap_ci(df, ["g"], ["y", "s"], metrics.auc_of, 100).first()
    again = metrics.bootstrap_ci(df.orderBy(F.desc("id")), ["g"], ["y", "s"], metrics.auc_of, 100).first()
    auc = metrics.roc_auc(df, "y", "s").first().auc
    assert first == again and first.low <= auc <= first.high
    assert metrics.bootstrap_ci(df.where("y = 1"), ["g"], ["y", "s"], metrics.auc_of, 10).first().low is None


def test_collapse(spark):
    r = np.random.default_rng(0)
    wide = spark.createDataFrame([(x.tolist(),) for x in r.normal(size=(400, 16))], "v array<double>")
    flat = spark.createDataFrame([((r.uniform(1, 2) * np.ones(16)).tolist(),) for _ in range(200)], "v array<double>")
    assert metrics.collapse(wide, "v", 16).first().rankme > 14
    low = metrics.collapse(flat, "v", 16).first()
    assert low.rankme < 2 and low.collapsed


def test_report_numbers(spark):
    rows = [(0, t, float(t), "ARMED" if t < 60 else "SEARCH", 55.0 if t < 360 else 65.0, 26.0 if t < 360 else 21.0) for t in range(660)]
    df = spark.createDataFrame(rows, "v int, n int, t double, state string, depth double, temp double").withColumn("dt", telemetry.step_seconds("v", "t", "n"))
    assert {r.state: r.seconds for r in telemetry.state_seconds(df, "state", "dt").collect()} == {"ARMED": 60.0, "SEARCH": 599.0}
    bands = telemetry.band_temperature(df, "depth", "temp", 10.0)
    step = telemetry.thermocline(bands).first()
    assert (step.upper, step.lower, step.step) == (50.0, 60.0, 5.0)
    assert telemetry.thermocline(bands, 6.0).count() == 0


def test_onset_counts_a_flicker_once(spark):
    rows = [(0, i, i * 0.2, i % 2 == 0) for i in range(20)]
    df = spark.createDataFrame(rows, "v int, n int, t double, hit boolean")
    assert df.withColumn("o", telemetry.onset("v", "t", "n", F.col("hit"), 3.0)).where("o").count() == 1


def test_retention(spark):
    df = spark.createDataFrame([("a", 0.0, 10, 5.0, False), ("a", 5.0, 10, 9.0, True), ("a", 9.0, 10, 12.0, False), ("a", 12.0, 10, None, False)], "k string, t0 double, size long, t1 double, keep boolean")
    gone = lambda free, protect: [r["delete"] for r in telemetry.retention(df, "k", "t0", "size", "t1", F.col("keep"), free, 25.0, protect).orderBy("t0").collect()]
    assert gone(0.0, 7.0) == [True, False, False, False]
    assert gone(0.0, 99.0) == [True, False, True, False]
    assert gone(30.0, 99.0) == [False] * 4


def test_metric_parity_and_tolerance(spark):
    got = spark.range(1).select(metrics.within_tolerance(F.lit(0.005), F.lit(0.5)).alias("a"), metrics.within_tolerance(F.lit(0.02), F.lit(0.5)).alias("b"), metrics.within_tolerance(F.lit(float("nan")), F.lit(None).cast("double")).alias("c")).first()
    assert tuple(got) == (True, False, True)
