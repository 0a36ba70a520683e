import numpy as np
import pytest

from loomcast.functions import degrade as G
from loomcast.functions import kernels as N
from loomcast.functions import masks
from loomcast.operators import images, robustness

PICTURE, _ = N.scene(3, animals=2)


@pytest.mark.parametrize("name", G.OPERATIONS)
def test_each_operation_changes_a_picture(name):
    for variant in ("train", "eval"):
        weak, strong = (G.degrade(PICTURE, [name], s, 11, variant) for s in (0.2, 1.0))
        assert weak.shape == strong.shape == PICTURE.shape and weak.dtype == np.uint8
        assert (strong != PICTURE).any() and (G.degrade(PICTURE, [name], 1.0, 11, variant) == strong).all()


def test_what_operations_do():
    mean = lambda x: x.reshape(-1, 3).mean(0)
    far = G.degrade(PICTURE, ["attenuation"], 1.0, 5, "train")
    assert (mean(far) < mean(PICTURE)).all() and mean(far)[0] / mean(PICTURE)[0] < mean(far)[1] / mean(PICTURE)[1]
    assert mean(G.degrade(PICTURE, ["low_light"], 1.0, 5)).sum() < 0.8 * mean(PICTURE).sum()
    edges = lambda x: np.abs(np.diff(x.astype(float), axis=1)).mean()
    assert edges(G.degrade(PICTURE, ["blur"], 1.0, 5)) < edges(PICTURE) < edges(G.degrade(PICTURE, ["noise"], 1.0, 5))
    assert (G.degrade(PICTURE, [], 1.0, 5) == PICTURE).all()
    black = np.full((32, 32, 3), 10, np.uint8)
    assert (G.degrade(black, ["low_light"], 1.0, 5) == black).all()
    with pytest.raises(ValueError):
        G.degrade(PICTURE, ["rain"], 1.0, 5)


def test_one_operation_does_not_change_what_another_draws():
    s = G.Scene(20, 30, 0.5, 9)
    apart = G.attenuation(np.ones((20, 30, 3)), s, frozenset({"attenuation"}))
    again = G.attenuation(np.ones((20, 30, 3)), G.Scene(20, 30, 0.5, 9), frozenset(G.OPERATIONS))
    assert (apart == again).all()


def test_kernels_and_codec():
    assert G.oval(11, 2.0, 3.0, 0.7).sum() == pytest.approx(1) and G.disk(9, 2.0, 0.5).sum() == pytest.approx(1)
    flat = np.full((17, 23, 3), 0.4)
    assert G.spread(flat, G.oval(9, 2.0)) == pytest.approx(flat)
    assert G.compressed(flat, 50) == pytest.approx(flat, abs=0.02)
    x = PICTURE / 255
    error = [np.abs(G.compressed(x, q) - x).mean() for q in (5, 30, 95)]
    assert error[0] > error[1] > error[2] and G.compressed(x, 95).shape == x.shape


def test_views():
    same = lambda mode: [(v == PICTURE).all() for v in G.views(PICTURE, mode, 4)]
    assert same("none") == [True, True]
    a, b = G.views(PICTURE, "shared", 4)
    assert (a == b).all()
    assert same("context_only")[1] and len({G.drawn(k) for k in range(30)}) > 10
    with pytest.raises(ValueError):
        G.views(PICTURE, "both", 4)


def test_crop_windows():
    for seed in range(200):
        top, left, h, w = masks.crop_window(64, 48, seed)
        assert 0 <= top <= 48 - h and 0 <= left <= 64 - w and 0.2 < h * w / (64 * 48) <= 1 and 0.6 < w / h < 1.6
    assert masks.crop_window(1000, 10, 0, (1.0, 1.0)) == (0, 493, 10, 13)


def test_block_masks():
    for overlap in (False, True):
        context, target = masks.block_masks(16, 14, 14, 3, masks.Blocks(overlap=overlap))
        assert target.shape[:2] == (16, 4) and context.shape[1] >= 10
        for c, t in zip(context, target):
            assert len(set(c)) == len(c) and (overlap or not set(c) & set(t.ravel()))
    few, _ = masks.block_masks(4, 3, 3, 0, masks.Blocks(target=(1.0, 1.0), keep=2))  # targets leave nothing
    assert few.shape[1] >= 1
    target, context = masks.mask_frequencies(8, 8, 1, 10, 16)
    assert target[3:5, 3:5].mean() > target[0, 0] and 0 < context.mean() < 1


def test_sweep(spark):
    rows = images.scenes(spark, 24)
    truth = rows.selectExpr("path", "CAST(size(boxes) > 0 AS INT) AS y")
    out = robustness.sweep(rows, truth, lambda x: float(x.std()), ["blur", "low_light"], [1, 5]).collect()
    assert {(r.operation, r.level) for r in out} == {("blur", 1), ("blur", 5), ("low_light", 1), ("low_light", 5)} and {r.n for r in out} == {24}
    assert robustness.random_crops(rows, 16, 20).collect()[0].height == 16
    both = robustness.training_views(rows.limit(3), "context_only").collect()
    assert len(both) == 6 and {r.view for r in both} == {"context", "target"}


def test_sweep_base(spark):
    df = spark.createDataFrame([(i, "clear" if i < 60 else "murky") for i in range(100)], "id long, slice string")
    assert robustness.sweep_base(df, "id", most=30).where("slice = 'clear'").count() == 30
    assert robustness.sweep_base(df, "id", least=61).count() == 100


def test_camera_pictures():
    y = np.full((4, 8), 100, np.uint8)
    planes = np.concatenate([y, np.full((2, 8), 128, np.uint8)])
    assert (robustness.yuv420_to_rgb(planes, 6, 4) == 100).all()
    planes[4] = 138  # more blue
    assert robustness.yuv420_to_rgb(planes, 6, 4)[0, 0].tolist() == [100, 96, 117]
    assert robustness.shrink_to(np.full((33, 50, 3), 7, np.uint8), 8, 12).shape == (8, 12, 3)
    x = robustness.model_input(np.full((16, 24, 3), 255, np.uint8), 8, 12)
    assert x.shape == (3, 8, 12) and x.max() == 1
    assert robustness.saved_size(1920, 540, True) == (512, 288) and robustness.saved_size(100, 80, False) == (100, 80)
    assert robustness.spread_times(16.0, 4) == [2.0, 6.0, 10.0, 14.0]


def test_video_frames(spark):
    rows = []
    for i in range(40):
        picture, _ = N.scene(i // 10, animals=1, size=(64, 64))
        picture[:8] = np.tile([[0], [255]], (4, 64))[..., None]  # lettering
        rows.append(("v", i / 10, False, *robustness.as_row("x", picture).values()))
    df = spark.createDataFrame([(v, t, i, p, h, w, c, bytearray(d)) for v, t, i, p, h, w, c, d in rows], f"video string, t double, interlaced boolean, {robustness.PICTURE}")
    bands = robustness.overlay_of(df).first()
    assert 0.1 < bands.top < 0.2 and bands.bottom == 0
    kept = robustness.video_frames(df, (bands.top, bands.bottom), fps=5.0, short_side=32).collect()
    assert [round(r.t, 1) for r in kept] == [0.0, 1.0, 2.0, 3.0] and {min(r.height, r.width) for r in kept} == {32}


def test_mask_coverage(spark):
    rows = robustness.coverage_of_masks(6, 6, 4, spark, 8).collect()
    assert len(rows) == 36 and sum(r.target for r in rows) > 4


def test_ingest(spark):
    rows = images.scenes(spark, 4)
    out = robustness.ingest(rows, rows.where("path = 'scene-0'"), 48).collect()
    assert {r.path for r in out} == {"scene-1", "scene-2", "scene-3"} and {(r.height, r.width, r.full_height, r.full_width) for r in out} == {(48, 64, 96, 128)}
    assert robustness.ingest(rows.limit(1), rows.limit(0), 500).first().height == 96
    mask = np.zeros((6, 6))
    mask[:3, :3] = 9
    assert robustness.fit_mask(mask, 2, 2).tolist() == [[1, 0], [0, 0]] and robustness.fit_mask(mask, 12, 12).sum() == 36
