import numpy as np
import pytest

from loomcast.operators import metrics, probes, reports


@pytest.fixture(scope="module")
def rows(spark):
    """Pictures of 4 x 4 tokens, whose first feature is high where an animal is."""
    r = np.random.default_rng(0)
    out = []
    for i in range(150):
        animal = i % 2
        cover = np.zeros((4, 4))
        if animal:
            y, x = r.integers(0, 3, 2)
            cover[y : y + 2, x : x + 2] = 1.0
        tokens = r.normal(0, 0.4, (16, 3))
        tokens[:, 0] += cover.ravel() * 2
        c = (float(x + 1) / 4, float(y + 1) / 4, 0.5) if animal else (None, None, None)
        out.append((f"i{i:03d}", ("train", "train", "val", "test", "test")[i % 5], ("dark", "murky", "clear")[i % 3], f"s{i % 2 + i % 4 // 2}", animal, tokens.tolist(), cover.ravel().tolist(), True, *c))
    return spark.createDataFrame(out, "image_id string, split string, slice string, source string, frame_label int, tokens array<array<double>>, coverage array<double>, patch_valid boolean, cx double, cy double, size double").cache()


def test_frame_probe(rows):
    _, blocks = probes.frame_probe(rows, [1e-3, 1e-2], reps=200)
    got = {r.block: r for r in blocks.collect()}
    assert {"all", "dark", "murky", "clear"} <= set(got) and got["all"].n == 60 and got["all"].auc > 0.95
    assert got["all"].low <= got["all"].auc <= got["all"].high <= 1


def test_patch_probe(rows):
    model, blocks = probes.patch_probe(rows, 4, 4, [1e-3])
    got = {r.block: r for r in blocks.collect()}
    assert set(got) == {"all", "dark", "murky", "clear"} and got["all"].patch_auc > 0.97 and got["all"].within_auc > 0.97 and got["all"].best_iou > 0.6
    assert got["all"].found == 1 and got["all"].error_median < 15 and got["all"].hit_rate > 0.9 and got["all"].frame_auc > 0.95
    heat = probes.heat_maps(model, rows).first().heat
    assert len(heat) == 16 and all(0 <= p <= 1 for p in heat)
    with pytest.raises(ValueError):
        probes.patch_probe(rows.where("frame_label = 0"), 4, 4)


def test_patch_samples(rows):
    few = probes.patch_samples(rows, 4, 4, most=40).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in few} == {0: 20, 1: 20}
    loose = rows.selectExpr("image_id", "tokens", "coverage", "false AS patch_valid")
    assert probes.patch_samples(loose.where("image_id = 'i000'"), 4, 4).count() == 0  # an empty picture that is not trusted


def test_online(rows):
    got = probes.online(rows, 4, 4)
    assert got["probe/frame_auroc"] > 0.95 and got["probe/patch_auroc"] > 0.97 and got["probe/centroid_found_frac"] == 1
    assert probes.online(rows.where("frame_label = 1"), 4, 4).keys() & {"probe/frame_auroc"} == set()


def test_bootstrap_does_not_depend_on_ranges(spark):
    r = np.random.default_rng(2)
    rows = [(i % 2, int(y), float(y) + float(r.normal())) for i in range(300) for y in (i % 3 == 0,)]
    df = spark.createDataFrame(rows, "g int, y int, s double")
    one = {x.g: (x.low, x.high) for x in metrics.bootstrap_auc(df, ["g"], "y", "s", 300, ranges=1).collect()}
    many = {x.g: (x.low, x.high) for x in metrics.bootstrap_auc(df, ["g"], "y", "s", 300, ranges=7).collect()}
    for g in (0, 1):
        auc = metrics.auc_of(np.array([(y, s) for k, y, s in rows if k == g]))
        assert one[g] == pytest.approx(many[g]) and one[g][0] < auc < one[g][1]
        resample = np.random.default_rng(g)
        own = np.array([(y, s) for k, y, s in rows if k == g])
        plain = [metrics.auc_of(own[resample.integers(0, len(own), len(own))]) for _ in range(600)]
        assert one[g] == pytest.approx(np.quantile(plain, [0.025, 0.975]), abs=0.04)
    whole = metrics.bootstrap_auc(df, [], "y", "s", 50).first()
    assert whole.low < whole.high
    assert metrics.bootstrap_auc(df.where("y = 1"), ["g"], "y", "s", 10).first().low is None or np.isnan(metrics.bootstrap_auc(df.where("y = 1"), ["g"], "y", "s", 10).first().low)


def test_reports(spark, rows, tmp_path):
    _, frames = probes.frame_probe(rows, [1e-3])
    _, heats = probes.patch_probe(rows, 4, 4, [1e-3])
    tag = lambda df: df.selectExpr("'vit' AS backbone", "'112x112' AS input", "*")
    costs = spark.createDataFrame([("vit_112x112", 5.5, 0.4, 12.0)], "model string, params_m double, gmacs double, fps double")
    robust = spark.createDataFrame([("vit", "112x112", "blur", k, 0.9 - k / 10) for k in (1, 2)], "backbone string, input string, operation string, level int, auc double")
    text = reports.evaluation(tag(frames), tag(heats), costs, robust)
    for part in ("## Input 112x112", "### Frames (AUROC)", "(n=60)", "### Patches and steering", "### Frames by source", "### Cost", "5.5", "### Synthetic degradations", "| vit | blur | 0.800 | 0.700 |"):
        assert part in text, part
    variants = spark.createDataFrame([("fp32", 0.9, 2.0), ("int8", 0.895, 2.5), ("int4", 0.8, None)], "runner string, auc double, centroid_deg double")
    told = reports.parity(variants, "fp32")
    assert "| int8 | 0.8950 | -0.0050 | 2.5000 | 0.5000 | pass |" in told and "| int4 | 0.8000 | -0.1000 | – | – | FAIL |" in told
    speeds = spark.createDataFrame([("m", "onnx", 4, 10.0 + i, None) for i in range(10)] + [("m", "ncnn", 4, None, "no file")], "model string, runtime string, threads int, ms double, error string")
    assert "68.97" in reports.speed(speeds) and "no file" in reports.speed(speeds)
    log = reports.MetricLog(spark, str(tmp_path / "log"))
    log.log(1, {"loss": 0.5, "note": "x"})
    log.log(2, {"loss": np.float32(0.25)})
    log.log(3, {})
    assert sorted(map(tuple, log.read().collect())) == [(1, "loss", 0.5), (2, "loss", 0.25)]


def test_runner_measures(rows):
    said = rows.where("split = 'test'").selectExpr("image_id", "frame_label", "coverage", "patch_valid", "cx", "cy", "size", "frame_label * 4.0D - 2 AS frame_logit", "transform(coverage, x -> x * 8 - 4) AS heat_logits")
    both = said.selectExpr("'a' AS runner", "*").unionByName(said.selectExpr("'b' AS runner", "*").withColumn("frame_label", probes.F.lit(1)))
    got = {r.runner: r for r in probes.runner_measures(both, 4, 4).collect()}
    assert got["a"].auc == 1 and got["a"].patch_auc == 1 and got["a"].centroid_deg < 1 and got["b"].auc is None
