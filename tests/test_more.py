import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.functions import columns as C
from loomcast.operators import experiments, patches, telemetry
from loomcast.sources import connectors
from loomcast.streaming import machines, run


def test_rays(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.0, 0.5), (0.2, 0.9)], "u double, v double")
    back = df.withColumn("a", C.ray_angles(F.col("u"), F.col("v"))).withColumn("b", C.ray_point(F.col("a.yaw"), F.col("a.pitch"))).collect()
    assert all((r.b.u, r.b.v) == pytest.approx((r.u, r.v)) for r in back)
    assert back[1].a.yaw == pytest.approx(math.degrees(math.asin(math.sin(math.radians(51)) / 1.333)))
    assert df.select(C.ray_angles(F.col("u"), F.col("v"), water=None).alias("a")).collect()[1].a.yaw == pytest.approx(51)


def test_grid(spark):
    runs = spark.createDataFrame([("a", 0.5, 1.0, None), ("a", 0.5, 3.0, None), ("b", 0.0, 2.0, None), ("b", 0.0, None, "broken")], "s string, lamp double, value double, error string")
    assert [tuple(r) for r in experiments.grid(runs, ["s", "lamp"], ["value"]).collect()] == [("a", 0.5, 2, 2.0, pytest.approx(math.sqrt(2))), ("b", 0.0, 1, 2.0, 0.0)]
    text = experiments.grid_report(runs, ["s", "lamp"], ["value"])
    assert "| a | 0.5 | 2 | 2.0 ± 1.4 |" in text and "1 runs failed" in text


def test_variants(spark, tmp_path):
    rows = spark.createDataFrame([("fp32", 160, 0.9), ("int8", 160, 0.85), ("int8", 224, 0.8)], "variant string, size int, auc double")
    got = {(r.variant, r["size"]): r.delta_auc for r in experiments.against(rows, "variant", "fp32", ["size"], ["auc"]).collect()}
    assert got[("int8", 160)] == pytest.approx(-0.05) and got[("int8", 224)] is None
    costs = spark.createDataFrame([("int8_160", 0.6)], "model string, gmacs double")
    assert {r.gmacs for r in experiments.with_costs(rows, costs, ["variant", "size"]).collect()} == {0.6, None}
    specs = spark.createDataFrame([("x", ["a", "b"]), ("y", ["a", "c"]), ("z", [])], "name string, files array<string>")
    assert {r.name for r in experiments.available(specs, "files", ["a", "b"]).collect()} == {"x", "z"}
    ms = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    told = experiments.latency(ms, [], "ms").first()
    assert told.p50 == 50.5 and told.fps == pytest.approx(1000 / 50.5)
    for name, body in (("train/x.json", {"images": [], "annotations": []}), ("val.json", [1]), ("y_valid.json", {"images": 1, "annotations": 2})):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body))
    heads = experiments.json_keys(spark, str(tmp_path))
    assert sorted((r.file.rsplit("/", 1)[1], r.split) for r in experiments.discover(heads.select("file"), heads).collect()) == [("x.json", "train"), ("y_valid.json", "val")]


def test_patch_block(spark):
    hot, cold = np.zeros((4, 4)), np.zeros((4, 4))
    hot[1, 2] = 1.0
    rows = [(i, "clear" if i % 2 else "dark", (hot * 0.9 + 0.05).ravel().tolist() if i < 4 else (cold + 0.05).ravel().tolist(), hot.ravel().tolist()) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, slice string, heat array<double>, cover array<double>")
    cells = patches.labelled(df, "heat", "cover", F.col("id") != 5).cache()
    assert cells.where("y = -1").count() == 15 and cells.where("y = 1").count() == 6
    truth = df.select("id", F.lit(0.625).alias("cx"), F.lit(0.375).alias("cy"), F.lit(0.25).alias("size"))
    all_ = patches.block(cells, truth, "id", 4, 4).first()
    assert all_.found == pytest.approx(4 / 6) and all_.error_median == pytest.approx(0) and all_.size_error == pytest.approx(0) and all_.hit_rate == 1.0
    assert all_.within_auc == pytest.approx((4 + 0.5) / 5) and 0.8 < all_.patch_auc < 1
    assert {r.slice for r in patches.block(cells, truth, "id", 4, 4, ["slice"]).collect()} == {"clear", "dark"}
    assert patches.max_heat_auc(cells.withColumn("label", (F.col("id") < 4).cast("int")), "id", "label").first().auc == 1.0


def test_more_windows(spark):
    rows = [(0, i, float(i), 100.0 - i if i < 50 else 50.0) for i in range(200)]
    df = spark.createDataFrame(rows, "v int, n int, t double, d double")
    out = telemetry.stalled(df, "v", "t", "n", "d").where("stalled").agg(F.min("t")).first()[0]
    assert out == 111.0
    cues = spark.createDataFrame([(0, 0, 0.0, 0.1, 0.1), (0, 1, 1.0, 0.9, 0.9), (0, 2, 2.0, 0.15, 0.1), (0, 3, 3.0, None, None), (0, 4, 4.0, 0.1, 0.15)], "v int, n int, t double, x double, y double")
    assert [r.repeated for r in telemetry.repeated_near(cues, "v", "t", "n", "x", "y").orderBy("n").collect()] == [False, False, True, False, True]
    assert [(r.t, r.mean) for r in telemetry.sampled_mean(df.where("t < 11"), "v", "t", "n", "n", 2).orderBy("t").collect()] == [(0.0, 0.0), (5.0, 4.5), (10.0, 9.5)]


def test_curiosity():
    m = machines.Curiosity()
    step = lambda t, flash=None, weak=None, searching=True: m.step({"t": t, "flash": flash, "weak": weak, "searching": searching})
    assert not step(0.0, weak=(0.1, 0.1))["looking"] and step(0.2, weak=(0.12, 0.1))["cue"] == "weak"
    assert step(1.0, flash=(0.9, 0.9))["cue"] == "flash" and step(2.9)["looking"] and not step(3.1)["looking"]
    assert not step(5.0, flash=(0.5, 0.5))["looking"] and step(11.2, flash=(0.5, 0.5))["looks"] == 2
    assert not step(11.4, searching=False)["looking"]


def test_guide():
    g = machines.Guide()
    out = []
    for i in range(300):
        there = 20 <= i < 150
        out.append(g.step({"t": i / 5, "frame_prob": 0.9 if there else 0.1, "peak": 0.0, "found": there, "yaw": 1.0, "pitch": 1.0, "size": 0.2, "blobs": 1, "vector": [1.0, 0.0]}))
    states = [r["state"] for r in out]
    assert [s for a, s in zip(["", *states], states) if a != s] == ["SEARCH", "ACQUIRE", "TRACK", "FILM", "LOST", "SEARCH"]
    ended = [r["encounter"] for r in out if r["encounter"]]
    assert len(ended) == 1 and ended[0]["reason"] == "lost" and ended[0]["good_s"] > 20


def test_frames_as_a_stream(spark):
    spark.dataSource.register(connectors.FrameSource)
    frames = spark.readStream.format("loomcast-frames").option("rows", 40).option("vehicles", 2).load()
    got = []
    query = frames.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).start()
    try:
        import time

        for _ in range(100):
            if len(got) >= 80:
                break
            time.sleep(0.2)
    finally:
        query.stop()
    assert len({(r.vehicle, r.frame) for r in got}) == 80
    assert run.tumbling is not None


def test_paged_service(spark):
    def get(url):
        offset, limit = (int(x.split("=")[1]) for x in url.split("?")[1].split("&"))
        return 200, json.dumps([{"uuid": i % 9} for i in range(offset, min(offset + limit, 10))]).encode()

    spark.dataSource.register(connectors.paged_source(get, "paged-test"))
    rows = spark.read.format("paged-test").option("url", "http://x/images").option("total", 10).option("page", 4).load()
    assert rows.select(F.from_json("value", "uuid INT").alias("r")).select("r.uuid").distinct().count() == 9


def test_retries():
    answers = iter([(503, b""), (429, b""), (200, b"ok")])
    assert connectors.fetch_retrying(lambda _: next(answers), "u", wait_s=0) == b"ok"
    asked = []
    with pytest.raises(OSError):
        connectors.fetch_retrying(lambda u: asked.append(u) or (404, b""), "u", wait_s=0)
    assert len(asked) == 1
