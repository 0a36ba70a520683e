"""Measures of heat maps against boxes on a grid of patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import metrics as M


def labelled(df: DataFrame, heat: str, coverage: str, valid: Column, positive: float = 0.3) -> DataFrame:
    """A row for each patch: its place, heat, coverage and label (1, 0, or -1); empty patches of images
    that are not trusted are -1."""
    zipped = F.posexplode(F.zip_with(heat, coverage, lambda p, c: F.struct(p.cast("double").alias("p"), c.cast("double").alias("c")))).alias("patch", "__z")
    rows = df.withColumn("__valid", valid).select("*", zipped).withColumns({"p": F.col("__z.p"), "c": F.col("__z.c")})
    label = F.when(F.col("c") >= positive, 1).when((F.col("c") <= 0) & F.col("__valid"), 0).otherwise(-1)
    return rows.withColumn("y", label).drop("__z", "__valid", heat, coverage)


def centroids(patches: DataFrame, id_col: str, rows: int, cols: int, gamma: float = 2.0, floor: float = 0.1) -> DataFrame:
    """(id, cx, cy, size, hit): the soft centroid of each image's heat, and whether its hottest patch
    touches a box; cx is null where there is no heat."""
    x = (F.col("patch") % cols + 0.5) / cols
    y = (F.floor(F.col("patch") / cols) + 0.5) / rows
    w = F.pow(F.greatest(F.lit(0.0), F.col("p") - floor), F.lit(gamma))
    sums = patches.withColumns({"__w": w, "__x": x, "__y": y}).groupBy(id_col).agg(F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__x")).alias("x"), F.sum(F.col("__w") * F.col("__y")).alias("y"), F.sqrt(F.avg((F.col("p") >= 0.5).cast("int"))).alias("size"), (F.max_by("c", F.struct("p", -F.col("patch"))) > 0).alias("hit"))
    some = F.col("w") > 1e-12
    return sums.select(id_col, F.when(some, F.col("x") / F.col("w")).alias("cx"), F.when(some, F.col("y") / F.col("w")).alias("cy"), "size", "hit")


def block(patches: DataFrame, truth: DataFrame, id_col: str, rows: int, cols: int, by: Sequence[str] = (), hfov: float = C.HFOV, vfov: float = C.VFOV) -> DataFrame:
    """(by, patch_auc, within_auc, found, error_median, error_p90, size_error, hit_rate): of all patches,
    within images, and of centroids against the truth (id, cx, cy, size) of images with an animal."""
    keys = list(by)
    rated = patches.where("y >= 0")
    pooled = M.roc_auc(rated, "y", "p", keys).select(*keys, F.col("auc").alias("patch_auc"))
    within = M.within_group_auc(rated, "y", "p", id_col, keys).select(*keys, F.col("mean_auc").alias("within_auc"))
    told = truth.select(id_col, F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("size").alias("ts"))
    found = centroids(patches, id_col, rows, cols).join(told, id_col)
    if keys:
        found = found.join(patches.select(id_col, *keys).distinct(), id_col)
    error = C.angular_error(F.col("cx") - F.col("tx"), F.col("cy") - F.col("ty"), hfov, vfov)
    size = F.when((F.col("size") > 0) & (F.col("ts") > 0) & F.col("cx").isNotNull(), F.abs(F.log(F.col("size") / F.col("ts"))))
    errors = found.groupBy(*keys).agg(F.avg(F.col("cx").isNotNull().cast("int")).alias("found"), F.median(error).alias("error_median"), F.percentile(error, 0.9).alias("error_p90"), F.median(size).alias("size_error"), F.avg(F.when(F.col("cx").isNotNull(), F.col("hit").cast("int"))).alias("hit_rate"))
    if keys:
        return pooled.join(within, keys).join(errors, keys, "left")
    return pooled.crossJoin(within).crossJoin(errors)


def max_heat_auc(patches: DataFrame, id_col: str, label: str) -> DataFrame:
    """AUC of the hottest patch of an image against its frame label."""
    return M.roc_auc(patches.where(F.col(label) >= 0).groupBy(id_col, label).agg(F.max("p").alias("top")), label, "top")
