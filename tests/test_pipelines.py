import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.functions import seeds
from loomcast.operators import curation, dive, images, planner, selection
from loomcast.sources import readers


@pytest.fixture(scope="module")
def measured(spark):
    """Scenes as records: each scene three times, the second nearly the same, the third in a group of its own."""
    scenes = images.scenes(spark, 40).withColumn("n", F.regexp_extract("path", r"(\d+)", 1).cast("int"))
    metrics = images.measure_images(scenes).withColumnRenamed("path", "scene")
    rows = scenes.join(metrics, scenes.path == metrics.scene).withColumn("copy", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    record = readers.make_record(
        rows.withColumn("row", F.struct("*")),
        "fish",
        image_id=F.concat_ws("-", "scene", "copy"),
        path=F.col("scene"),
        group_id=F.concat(F.lit("g"), F.when(F.col("copy") == 2, F.col("n") + 100).otherwise(F.floor(F.col("n") / 3)).cast("string")),
        license=F.when(F.col("n") % 10 == 0, "CC BY-NC 4.0").otherwise("CC BY 4.0"),
        width=F.lit(128),
        height=F.lit(96),
        boxes=F.col("boxes"),
        box_labels=F.transform("boxes", lambda b: F.lit("fish")),
        box_is_animal=F.transform("boxes", lambda b: F.lit(True)),
        frame_label=F.when(F.size("boxes") > 0, 1).when(F.col("n") % 2 == 0, 0).otherwise(-1),
        boxes_exhaustive=F.lit(True),
    )
    return record.join(metrics.withColumnRenamed("scene", "path"), "path").cache()


def test_curation(spark, measured):
    settings = curation.Settings.of({"commercial_only": True, "per_group": 4, "source_caps": {"nobody": 0.5}, "unknown key": 1})
    index, removed, log = curation.curate(measured, settings)
    index, removed = index.cache(), removed.cache()
    rows = index.collect()
    assert len(rows) + removed.count() == measured.count() == 120
    assert {r.removed_reason for r in removed.collect()} >= {"license_filter", "near_dup"}
    assert removed.where("removed_reason = 'license_filter'").count() == 12
    assert index.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    train = [r.weight for r in rows if r.split == "train"]
    assert np.mean(train) == pytest.approx(1) and all(r.weight == 0 for r in rows if r.split != "train")
    clusters = {}
    for r in rows:
        clusters.setdefault(r.dup_cluster, []).append(r.split)
    assert all(len(x) == len(set(x)) and not ("train" in x and len(x) > 1) and not {"val", "test"} <= set(x) for x in clusters.values())
    again, _, _ = curation.curate(measured.orderBy(F.rand(3)), settings)
    assert {(r.image_id, r.split) for r in again.collect()} == {(r.image_id, r.split) for r in rows}
    text = curation.report(index, removed, log)
    assert all(x in text for x in ("Images per source", "Licenses", "Labels", "Box sizes", "CC-BY-4.0"))
    assert [s["step"] for s in log["steps"]] == ["readable", "split", "duplicates", "empty", "group_cap", "final"]


def test_selection(spark, measured):
    index = measured.withColumns({"split": F.lit("train"), "slice": F.lit("clear"), "weight": F.when(F.col("frame_label") == 0, 0.0).otherwise(2.0)})
    crops = selection.frame_rows(index, "train", ["fish"], 2)
    assert crops.where("source = 'fish_crops' and crop is not null").count() == crops.count() > 0
    assert selection.frame_rows(index, "train", most=7).count() == 7
    assert selection.patch_rows(index, "train").where("frame_label = -1 and size(boxes) = 0").count() == 0
    assert selection.pool(index, True).where("weight = 0.000001").count() > 0
    assert selection.parity_rows(index).count() == 0
    rows = selection.supervision(index, 4, 4).collect()
    assert all(len(r.coverage) == 16 == len(r.targets) and r.patch_valid for r in rows) and any(r.centroid.cx == -1 for r in rows)
    taxa = spark.createDataFrame([("fish", "fishes")], "concept string, taxon string")
    assert selection.sprites(index, ["fish"], "train", 1, taxa).select("taxon").distinct().count() == 1
    assert selection.sprites(index, ["fish"], "train", 1000, taxa).count() == 0
    assert selection.robustness_grid(index.limit(2), ["blur", "noise"], [1, 2, 3]).count() == 12
    box = spark.range(1).select(selection.with_crop(F.array(F.array(*map(F.lit, (0.25, 0.25, 0.5, 0.5))), F.array(*map(F.lit, (0.9, 0.9, 1.0, 1.0)))), F.array(*map(F.lit, (0.25, 0.0, 0.75, 0.5)))).alias("b")).first().b
    assert box == [[0.0, 0.5, 0.5, 1.0]]


def test_planner(spark):
    rows = [(k, float(b), 30.0 if b == 125 else 0.0, 600.0, 1.0, b != 5) for k in range(60) for b in range(5, 200, 10)]
    df = spark.createDataFrame(rows, "k int, band double, events double, exposure double, prior double, reachable boolean")
    picks = [r.band for r in planner.choose_bands(df, "k", 0).collect()]
    assert len(picks) == 60 and sum(p == 125.0 for p in picks) > 48 and 5.0 not in picks
    hours = spark.createDataFrame([(12.0, 25.0), (19.0, 105.0), (19.0, 25.0), (0.0, 60.0)], "h double, b double")
    assert [round(r.w, 1) for r in hours.select(planner.diel_prior(F.col("b"), F.col("h")).alias("w")).collect()] == [1.0, 3.0, 1.0, 2.5]
    assert hours.select(planner.posterior_rate(F.lit(5.0), F.lit(0.0)).alias("r")).first().r == pytest.approx(5.05)


def test_seeds(spark):
    assert seeds.derive_seed(0, "split", "g") == seeds.derive_seed(0, "split", "g") != seeds.derive_seed(0, "split", "h")
    df = spark.createDataFrame([(f"g{i % 50}",) for i in range(200)], "g string").select("g", seeds.seeded01(0, "split", F.col("g")).alias("u"))
    got = {r.g: r.u for r in df.collect()}
    assert got["g3"] == seeds.derive_seed(0, "split", "g3") % 1_000_003 / 1_000_003 and 0.3 < np.mean(list(got.values())) < 0.7


def test_dive_report(spark, tmp_path):
    lines = []
    for t in range(660):
        state = "SAFE" if t < 60 else "SEARCH" if t % 30 else "ACQUIRE"
        lines.append({"kind": "guidance", "t": float(t), "frame": t, "state": state, "events": ["mission_start"] if t == 60 else ["state:ACQUIRE"] if state == "ACQUIRE" else [], "nav": {"depth_m": 55.0 if t < 360 else 65.0, "temp_c": 26.0 if t < 360 else 21.0}, "cmd": {"light": 0.5}, "curiosity": {"looking": t % 100 > 95, "cue": "flash"}})
    lines += [{"kind": "encounter", "id": i, "reason": "lost" if i else "enough", "t_start": 1.0, "t_end": 2.0, "engaged_s": 10.0 * i, "good_s": 1.0, "value": 0.5, "novelty_weight": 1.5, "behaviour": "drifter"} for i in range(3)]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)))
    frames, encounters = readers.read_logs(spark, str(path))
    text = dive.report(frames, encounters)
    assert "Steepest change: 5.0 °C between 50–60 m and 60–70 m" in text and "| lost | 2 | 15 |" in text and "| flash |" in text
    told = dive.mission(dive.timed(frames)).first()
    assert told.missions == 1 and told.outside_minutes == pytest.approx(1.0) and told.minutes == pytest.approx(659 / 60)
    assert dive.report(frames.limit(0), encounters) == "No guidance telemetry found."
