"""Which rows of an index an evaluation, a probe or a training run takes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from . import images, sampling


def frame_rows(index: DataFrame, split: str, crop_sources: Sequence[str] = (), n: int = 4, most: int | None = None, seed: int = 0) -> DataFrame:
    """Labelled frames of a split, and for sources that have boxes only, crops in their place: a row for
    each, with the crop's label and the source's name and `_crops`. Of train, at most `most` by hash."""
    rows = index.where(F.col("split") == split)
    crop_source = F.col("source").isin(*crop_sources) if crop_sources else F.lit(False)
    whole = rows.where(F.col("frame_label").isin(0, 1) & ~crop_source).withColumn("crop", F.lit(None).cast("array<double>"))
    if crop_sources:
        boxed = rows.where(crop_source & (F.size("boxes") > 0))
        cut = images.crops(boxed, "image_id", "boxes", "box_is_animal", n).select(F.col("id").alias("image_id"), "crop", F.col("label").alias("__label"))
        made = boxed.join(cut, "image_id").withColumns({"frame_label": F.col("__label"), "source": F.concat(F.col("source"), F.lit("_crops"))}).drop("__label")
        whole = whole.unionByName(made.select(whole.columns))
    if split == "train" and most is not None:
        key = F.concat_ws("|", "image_id", F.coalesce(F.to_json(F.struct("crop")), F.lit("")))
        whole = sampling.uniform(whole, C.hash01(seed, "frames", key), "image_id", most)
    return whole


def patch_rows(index: DataFrame, split: str) -> DataFrame:
    """Rows of a split that say where animals are or that there are none."""
    says = C.has_text(F.col("mask_path")) | (F.size("boxes") > 0) | (F.col("frame_label") == 0)
    return index.where((F.col("split") == split) & says)


def pool(index: DataFrame, commercial: bool = False, sources: Sequence[str] = ()) -> DataFrame:
    """The training pool, with positive weights."""
    keep = F.col("split") == "train"
    if commercial:
        keep = keep & F.col("train_commercial_ok")
    if sources:
        keep = keep & F.col("source").isin(*sources)
    return index.where(keep).withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1e-6))


def parity_rows(index: DataFrame) -> DataFrame:
    return index.where((F.col("split") == "test") & ((F.col("frame_label") != -1) | (F.size("boxes") > 0)))


def sprites(index: DataFrame, sources: Sequence[str], split: str, least_px: int, taxa: DataFrame) -> DataFrame:
    """A row for each animal box of at least `least_px` on its short side whose concept has a known
    taxon group (taxa: concept, taxon)."""
    own = index.where(F.col("source").isin(*sources) & (F.col("split") == split))
    each = own.select("image_id", "path", "width", "height", F.explode(F.arrays_zip("boxes", "box_labels", "box_is_animal")).alias("b")).where(F.col("b.box_is_animal"))
    rows = each.select("image_id", "path", "width", "height", F.col("b.boxes").alias("box"), F.col("b.box_labels").alias("concept"))
    short = F.least((F.col("box")[2] - F.col("box")[0]) * F.col("width"), (F.col("box")[3] - F.col("box")[1]) * F.col("height"))
    return rows.where(short >= least_px).join(F.broadcast(taxa.select("concept", "taxon")), "concept")


def supervision(index: DataFrame, rows: int, cols: int) -> DataFrame:
    """(image_id, coverage, targets, patch_valid, centroid, slice) of each row, on a grid of patches; the
    centroid is (-1, -1, -1) where there is none."""
    animal = F.transform(F.filter(F.arrays_zip("boxes", "box_is_animal"), lambda x: x["box_is_animal"]), lambda x: x["boxes"])
    own = index.withColumn("__animal", animal)
    cover = images.coverage(own, "image_id", "__animal", rows, cols).select(F.col("id").alias("image_id"), "coverage")
    place = C.centroid_and_size(F.col("__animal"))
    none = F.struct(F.lit(-1.0).alias("cx"), F.lit(-1.0).alias("cy"), F.lit(-1.0).alias("size"))
    valid = C.has_text(F.col("mask_path")) | F.col("boxes_exhaustive") | (F.col("frame_label") == 0)
    out = own.select("image_id", valid.alias("patch_valid"), F.coalesce(place, none).alias("centroid"), "slice")
    return out.join(cover, "image_id").withColumn("targets", C.patch_targets(F.col("coverage")))


def robustness_grid(rows: DataFrame, operations: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """Each row under each operation and level; the grid is a few dozen settings."""
    settings = F.array(*[F.struct(F.lit(o).alias("operation"), F.lit(float(v)).alias("level")) for o in operations for v in levels])
    return rows.select("*", F.inline(settings))


def with_crop(boxes: Column, crop: Column) -> Column:
    """Boxes relative to a crop; those outside are left out."""
    side = lambda i: crop[i + 2] - crop[i]
    edge = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    inner = F.transform(boxes, lambda b: F.array(*[edge((b[i] - crop[i % 2]) / side(i % 2)) for i in range(4)]))
    return F.filter(inner, lambda b: (b[2] > b[0]) & (b[3] > b[1])).cast(T.ArrayType(T.ArrayType(T.DoubleType())))
