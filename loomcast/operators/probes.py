"""Probes of frozen features: of whole frames and of patches, and the heat maps that a patch probe gives.

Rows are (image_id, split, slice, frame_label, tokens, coverage, patch_valid, cx, cy, size): the tokens
of a grid of patches and the share of each that boxes cover; cx is null where there is no animal.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as N
from . import metrics, patches, sampling
from .images import rows_to_rows

DECAYS = (1e-4, 1e-3, 1e-2, 1e-1)
SLICES = ("dark", "murky", "clear")


def labelled_rows(index: DataFrame) -> DataFrame:
    """Rows that say anything of animals: by a label, boxes or a mask."""
    return index.where((F.col("frame_label") != -1) | (F.size("boxes") > 0) | C.has_text(F.col("mask_path")))


def pooled(rows: DataFrame) -> DataFrame:
    """Rows with features, the mean of their tokens."""
    dims = F.sequence(F.lit(1), F.size(F.col("tokens")[0]))
    mean = F.transform(dims, lambda i: F.aggregate("tokens", F.lit(0.0), lambda s, t: s + F.element_at(t, i).cast("double")) / F.size("tokens"))
    return rows.withColumn("features", mean)


def patch_samples(rows: DataFrame, height: int, width: int, positive: float = 0.3, margin: int | None = 1, most: int = 200_000, seed: int = 0) -> DataFrame:
    """(id, features, y) of patches to learn from: at most half of `most` that boxes cover enough, and of
    background as many, or as many as there are positive ones; both chosen by hash."""

    def each(row: dict) -> list[dict]:
        cover = np.asarray(row["coverage"], dtype=np.float64).reshape(height, width)
        empty = N.patch_negatives(cover, bool(row["patch_valid"]), margin).ravel()
        y = np.where(cover.ravel() >= positive, 1, np.where(empty, 0, -1))
        return [{"id": f"{row['image_id']}#{i}", "features": row["tokens"][i], "y": int(y[i])} for i in np.flatnonzero(y >= 0)]

    cells = rows_to_rows(rows.select("image_id", "tokens", "coverage", "patch_valid"), each, "id string, features array<double>, y int")
    unit = C.hash01(seed, "patches", F.col("id"))
    hits = sampling.uniform(cells.where("y = 1"), unit, "id", most // 2)
    return hits.unionByName(sampling.uniform(cells.where("y = 0"), unit, "id", max(most // 2, hits.count())))


def heat_maps(model, rows: DataFrame) -> DataFrame:
    """Rows with heat, the probability of each patch."""
    w, b = model.coefficients.toArray().tolist(), float(model.intercept)
    weights = F.array(*map(F.lit, w))
    score = lambda t: F.aggregate(F.zip_with(t, weights, lambda x, y: x * y), F.lit(b), lambda s, x: s + x)
    return rows.withColumn("heat", F.transform("tokens", lambda t: C.sigmoid(score(t))))


def _scores(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, n_pos, auc, ap, tpr) of (image_id, frame_label, p); blocks of fewer than five rows or one
    class are left out."""
    auc = metrics.roc_auc(scored, "frame_label", "p", by).where((F.col("n") >= 5) & ~F.isnan("auc"))
    ap = metrics.average_precision(scored, "frame_label", "p", "image_id", by).drop("n_pos")
    tpr = metrics.tpr_at_fpr(scored, "frame_label", "p", 0.05, by).drop("threshold")
    keys = list(by)
    return auc.join(ap, keys).join(tpr, keys)


def frame_probe(rows: DataFrame, decays: Sequence[float] = DECAYS, reps: int = 0) -> tuple[object, DataFrame]:
    """(model, blocks): a probe fitted on train, its weight decay chosen on val, scored on test; blocks
    are all rows, each slice and each source, with an interval where `reps` resamples are asked for."""
    told = pooled(rows.where(F.col("frame_label").isin(0, 1)))
    part = lambda s: told.where(F.col("split") == s)
    model, _ = metrics.select_probe(part("train"), part("val"), "features", F.col("frame_label") == 1, decays)
    return model, score_blocks(metrics.score_probe(model, part("test"), "features"), reps)


def score_blocks(scored: DataFrame, reps: int = 0) -> DataFrame:
    """(block, n, n_pos, auc, ap, tpr, low, high) of scored frames."""
    blocks = [("all", F.lit(True)), *[(s, F.col("slice") == s) for s in SLICES]]
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in blocks], *([F.concat(F.lit("source:"), "source")] if "source" in scored.columns else [])))
    each = scored.select("image_id", "frame_label", "p", F.explode(names).alias("block"))
    out = _scores(each, ["block"])
    if reps:
        return out.join(metrics.bootstrap_auc(each, ["block"], "frame_label", "p", reps), "block")
    return out.withColumns({"low": F.lit(float("nan")), "high": F.lit(float("nan"))})


def patch_probe(rows: DataFrame, height: int, width: int, decays: Sequence[float] = DECAYS, most: int = 200_000) -> tuple[object, DataFrame]:
    """(model, blocks): a probe of patches fitted on train and chosen on val, and the measures of its heat
    maps on test. Raises where train has patches of one kind only."""
    part = lambda s: rows.where(F.col("split") == s)
    train, val = patch_samples(part("train"), height, width, most=most), patch_samples(part("val"), height, width, most=most)
    if train.select("y").distinct().count() < 2:
        raise ValueError("a patch probe needs patches with animals and without")
    model, _ = metrics.select_probe(train, val, "features", F.col("y") == 1, decays)
    return model, heat_blocks(heat_maps(model, part("test")), height, width)


def heat_blocks(rows: DataFrame, height: int, width: int) -> DataFrame:
    """(block, images, patch_auc, patch_ap, best_iou, within_auc, found, error_median, error_p90,
    size_error, hit_rate, frame_auc) of heat maps, for all rows and each slice."""
    out: DataFrame | None = None
    for name in ("all", *SLICES):
        own = rows if name == "all" else rows.where(F.col("slice") == name)
        own = own.withColumn("block", F.lit(name))
        cells = patches.labelled(own.select("image_id", "block", "heat", "coverage", "patch_valid", "frame_label"), "heat", "coverage", F.col("patch_valid"))
        truth = own.where("cx is not null").select("image_id", "cx", "cy", "size")
        told = patches.block(cells, truth, "image_id", height, width, ["block"])
        rated = cells.where("y >= 0").withColumn("__id", F.concat_ws("#", "image_id", "patch"))
        ap = metrics.average_precision(rated, "y", "p", "__id", ["block"]).select("block", F.col("ap").alias("patch_ap"))
        trusted = cells.where("patch_valid") if "patch_valid" in cells.columns else rated
        iou = metrics.best_iou(trusted.withColumn("__hit", (F.col("c") >= 0.3).cast("int")), "__hit", "p", ["block"]).select("block", "best_iou")
        top = patches.max_heat_auc(cells, "image_id", "frame_label").select(F.lit(name).alias("block"), F.col("auc").alias("frame_auc"))
        images = own.groupBy("block").agg(F.count("*").alias("images"))
        one = images.join(told, "block", "left").join(ap, "block", "left").join(iou, "block", "left").join(top, "block", "left")
        out = one if out is None else out.unionByName(one)
    return out


def online(rows: DataFrame, height: int, width: int, decay: float = 1e-3, most: int = 200_000, least: int = 20) -> dict[str, float]:
    """The measures that a training run logs of its features: of frames, if train has both labels and
    more than ten rows, and of patches, if it has more than `least` of each kind."""
    out: dict[str, float] = {}
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    framed = F.col("frame_label").isin(0, 1)
    counts = {r[0]: r[1] for r in train.where(framed).groupBy("frame_label").count().collect()}
    if len(counts) == 2 and sum(counts.values()) > 10:
        model = metrics.fit_probe(pooled(train.where(framed)), "features", F.col("frame_label") == 1, decay)
        for r in score_blocks(metrics.score_probe(model, pooled(val.where(framed)), "features")).collect():
            if r.block == "all":
                out |= {"frame_auroc": r.auc, "frame_ap": r.ap, "frame_tpr_at_5fpr": r.tpr}
            elif r.block in SLICES:
                out[f"frame_auroc_{r.block}"] = r.auc
    cells = patch_samples(train, height, width, most=most).cache()
    kinds = {r[0]: r[1] for r in cells.groupBy("y").count().collect()}
    if min(kinds.get(0, 0), kinds.get(1, 0)) > least:
        model = metrics.fit_probe(cells, "features", F.col("y") == 1, decay)
        told = heat_blocks(heat_maps(model, val), height, width).where("block = 'all'").first()
        names = {"patch_auroc": "patch_auc", "patch_ap": "patch_ap", "patch_within_image_auroc": "within_auc", "centroid_err_deg_median": "error_median", "centroid_found_frac": "found"}
        out |= {k: told[c] for k, c in names.items() if told and told[c] is not None and told[c] == told[c]}
    cells.unpersist()
    return {f"probe/{k}": float(v) for k, v in out.items()}


def runner_measures(outputs: DataFrame, height: int, width: int) -> DataFrame:
    """(runner, auc, patch_auc, centroid_deg) of each runner's outputs (runner, image_id, frame_logit,
    heat_logits, frame_label, coverage, patch_valid, cx, cy, size), for reports.parity; a measure that a
    runner's rows cannot tell is null."""
    rows = outputs.withColumn("heat", F.transform("heat_logits", lambda x: C.sigmoid(x)))
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    frames = metrics.roc_auc(rows.where("frame_label >= 0"), "frame_label", "frame_logit", ["runner"]).select("runner", known("auc").alias("auc"))
    cells = patches.labelled(rows.select("runner", F.concat_ws("|", "runner", "image_id").alias("image_id"), "heat", "coverage", "patch_valid"), "heat", "coverage", F.col("patch_valid"))
    truth = rows.where("cx is not null").select(F.concat_ws("|", "runner", "image_id").alias("image_id"), "cx", "cy", "size")
    told = patches.block(cells, truth, "image_id", height, width, ["runner"]).select("runner", known("patch_auc").alias("patch_auc"), F.col("error_median").alias("centroid_deg"))
    return rows.select("runner").distinct().join(frames, "runner", "left").join(told, "runner", "left")


def heat_threshold(prob: Column, threshold: float = 0.5) -> Column:
    """Whether a heat map has any patch over a threshold."""
    return F.exists(prob, lambda p: p >= threshold)
