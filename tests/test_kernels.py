import numpy as np
import pytest

from loomcast.functions import kernels as N
from loomcast.operators import dedup, images


def test_coverage_and_negatives():
    c = N.box_coverage([[0.0, 0.0, 0.5, 0.25], [0.25, 0.0, 0.5, 0.25]], 4, 4)
    assert c[0].tolist() == [1, 1, 0, 0] and c[1:].sum() == 0
    one = np.zeros((6, 6))
    one[0, 0] = 1
    assert N.patch_negatives(one, True).sum() == 35
    assert N.patch_negatives(one, False).sum() == 32
    assert N.patch_negatives(one, False, None).sum() == 0 and N.patch_negatives(np.zeros((6, 6)), False).sum() == 0
    mask = np.zeros((32, 32))
    mask[:16] = 1
    assert N.mask_coverage(mask, 4, 4)[:2] == pytest.approx(1) and N.mask_coverage(mask, 4, 4)[2:] == pytest.approx(0)


def test_centroid_and_blobs():
    heat = np.zeros((4, 4))
    heat[1, 2] = 1
    assert N.soft_centroid(heat) == pytest.approx((0.625, 0.375, 0.25)) and N.soft_centroid(heat * 0.05) is None
    heat = np.zeros((12, 12))
    heat[1:4, 1:4], heat[7:12, 7:12] = 1, 1
    found = N.blobs(heat)
    assert len(found) == 2 and found[0]["cx"] > 0.7 and N.preferred(found, (0.2, 0.2))["cx"] < 0.3 and not N.blobs(np.full((4, 4), 0.1)) and len(N.blobs(heat * 0.55, least_mass=6)) == 1 and N.preferred(found, None)["cx"] > 0.7 and N.preferred([], None) is None


def test_components():
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1]], bool)
    assert N.components(mask).tolist() == [[1, 0, 0, 2], [0, 1, 0, 0], [0, 0, 0, 3]]
    assert N.components(np.ones((3, 3), bool)).tolist() == [[1] * 3] * 3 and N.components(np.zeros((2, 2), bool)).sum() == 0
    spiral = np.ones((9, 9), bool)
    spiral[1, :8] = spiral[3, 1:] = spiral[5, :8] = spiral[7, 1:] = False
    assert N.components(spiral).max() == 1
    boxes = np.zeros((20, 20))
    boxes[2:8, 3:9], boxes[15, 15] = 1, 1
    assert N.mask_boxes(boxes) == [[3, 2, 9, 8]]


def test_crops():
    boxes = np.array([[0.4, 0.4, 0.6, 0.6]])
    for crop, label in N.presence_crops(boxes, [True], 3, 8):
        inside = np.clip(np.minimum(boxes[0, 2:], crop[2:]) - np.maximum(boxes[0, :2], crop[:2]), 0, None).prod() / 0.04
        assert inside >= 0.5 if label else inside == 0
    assert {label for _, label in N.presence_crops(np.zeros((0, 4)), [], 1)} == {0}


def test_resize_and_filters():
    a = np.arange(12.0).reshape(3, 4)
    assert N.resize(a, 3, 4) == pytest.approx(a) and N.resize(a, 6, 8).mean() == pytest.approx(a.mean())
    assert N.box_mean(np.ones((5, 6)), 3) == pytest.approx(1)
    b = N.box_mean(a, 3)
    assert b[1, 1] == pytest.approx(a[:, :3].mean()) and b.shape == a.shape
    basis = N.cosine_basis(8)
    assert basis @ basis.T == pytest.approx(np.eye(8))
    assert N.sincos_position(8, 2, 3).shape == (6, 8)


def test_descriptor_and_overlay():
    tokens = np.zeros((2, 2, 3))
    tokens[0, 0] = [3, 0, 0]
    prob = np.array([[1.0, 0], [0, 0]])
    assert N.blob_descriptor(tokens, prob, None).tolist() == [1, 0, 0] and N.blob_descriptor(tokens, prob * 0, None) is None
    frames = np.random.default_rng(0).normal(0.4, 0.1, (8, 50, 40))
    frames[:, 2:6] = np.repeat(np.tile([0.0, 1.0], 10), 2)
    top, bottom = N.overlay_bands(frames)
    assert 0.1 <= top <= 0.16 and bottom == 0 and N.overlay_bands(frames[:, ::-1])[1] > 0.1
    assert N.overlay_bands(frames[:, 10:]) == (0, 0) == N.overlay_bands(frames[:3])


def test_conditions_on_scenes(spark):
    rows = images.measure_images(images.scenes(spark, 60)).join(images.scenes(spark, 60).select("path", "condition"), "path").collect()
    by = {c: [r for r in rows if r.condition == c] for c in ("clear", "murky", "dark")}
    assert all(r.metric_error is None for r in rows)
    assert np.mean([r.lum_mean < 0.10 for r in by["dark"]]) > 0.9
    assert np.median([r.clarity for r in by["clear"]]) > np.median([r.clarity for r in by["murky"]]) + 0.2


def test_broken_images_are_rows(spark):
    bad = images.scenes(spark, 1).selectExpr("path", "height + 1 AS height", "width", "channels", "data")
    assert images.measure_images(bad).first().metric_error.startswith("ValueError")


def test_jittered_copies_cluster(spark):
    rows = []
    for i in range(6):
        picture, _ = N.scene(100 + i, animals=2)
        for k in range(3):
            copy = picture.astype(float) + np.random.default_rng(k).normal(0, 2, picture.shape) + k
            rows.append((3 * i + k, N.perceptual_hash(copy.clip(0, 255)), bytearray(N.thumbnail(copy.clip(0, 255)))))
    assert all(N.thumbnail_distance(bytes(rows[3 * i][2]), bytes(rows[3 * i + 1][2])) < 1.2 for i in range(6))
    df = spark.createDataFrame(rows, "id long, phash long, thumb binary")
    got = {r.id: r.dup_cluster for r in dedup.near_duplicate_clusters(df, "id", "phash").collect()}
    assert got == {i: i // 3 * 3 for i in range(18)}


def test_crops_and_coverage_of_rows(spark):
    df = spark.createDataFrame([(1, [[0.0, 0.0, 0.5, 0.5]], [True]), (2, [], [])], "id long, boxes array<array<double>>, animal array<boolean>")
    assert {r.id: sum(r.coverage) for r in images.coverage(df, "id", "boxes", 4, 4).collect()} == {1: 4.0, 2: 0.0}
    assert {r.id for r in images.crops(df, "id", "boxes", "animal").collect()} == {"1", "2"}
