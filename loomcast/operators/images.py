"""Operators that apply the array kernels to rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as N
from ..sources.readers import METRICS

MEASURED = ", ".join(f"{m} double" for m in METRICS) + ", phash long, thumb binary, metric_error string"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data) of the images of a folder, decoded; rows of pixels from the
    top, blue first. What cannot be decoded is left out."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def to_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[..., 2::-1]


def fit(image: np.ndarray, most: int) -> np.ndarray:
    """The image with its long side at most `most`."""
    h, w = image.shape[:2]
    if max(h, w) <= most:
        return image
    scale = most / max(h, w)
    return N.resize(image, max(1, round(h * scale)), max(1, round(w * scale))).round().astype(np.uint8)


def rows_to_rows(df: DataFrame, each: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Apply a function of a row that gives rows, batch by batch."""
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            yield pa.RecordBatch.from_pylist([out for row in batch.to_pylist() for out in each(row)], schema=arrow)

    return df.mapInArrow(run, kind)


def _measure(row: dict, most: int) -> list[dict]:
    try:
        image = fit(to_array(row["height"], row["width"], row["channels"], row["data"]), most)
        return [{"path": row["path"], **N.condition_metrics(image), "phash": N.perceptual_hash(image), "thumb": N.thumbnail(image), "metric_error": None}]
    except Exception as problem:  # an image that cannot be measured is a row with the reason
        return [{"path": row["path"], "metric_error": f"{type(problem).__name__}: {problem}"[:200]}]


def measure_images(images: DataFrame, most: int = 256) -> DataFrame:
    """(path, metrics, phash, thumb, metric_error) of decoded images."""
    return rows_to_rows(images, lambda row: _measure(row, most), f"path string, {MEASURED}")


def coverage(df: DataFrame, id_col: str, boxes: str, height: int, width: int) -> DataFrame:
    """(id, coverage) of the patches of each row's corner boxes, by rows of patches."""
    kind = df.schema[id_col].dataType.simpleString()
    return rows_to_rows(df.select(F.col(id_col).alias("id"), F.col(boxes).alias("boxes")), lambda r: [{"id": r["id"], "coverage": N.box_coverage(r["boxes"] or [], height, width).ravel().tolist()}], f"id {kind}, coverage array<double>")


def find_blobs(df: DataFrame, id_col: str, heat: str, height: int, width: int, high: float = 0.5, low: float | None = None) -> DataFrame:
    """A row (id, rank, cx, cy, size, mass, peak) for each blob of each heat map."""
    kind = df.schema[id_col].dataType.simpleString()

    def each(r: dict) -> list[dict]:
        found = N.blobs(np.asarray(r["heat"], dtype=np.float64).reshape(height, width), high, low)
        return [{"id": r["id"], "rank": i, **b} for i, b in enumerate(found)]

    return rows_to_rows(df.select(F.col(id_col).alias("id"), F.col(heat).alias("heat")), each, f"id {kind}, rank int, cx double, cy double, size double, mass double, peak double")


def crops(df: DataFrame, id_col: str, boxes: str, animal: str, n: int = 4) -> DataFrame:
    """A row (id, crop, label) for each presence crop; the seed of a row is its id."""
    import zlib

    def each(r: dict) -> list[dict]:
        found = N.presence_crops(np.array(r["boxes"] or [], dtype=np.float64), np.array(r["animal"] or [], dtype=bool), zlib.crc32(str(r["id"]).encode()), n)
        return [{"id": str(r["id"]), "crop": crop, "label": label} for crop, label in found]

    return rows_to_rows(df.select(F.col(id_col).alias("id"), F.col(boxes).alias("boxes"), F.col(animal).alias("animal")), each, "id string, crop array<double>, label int")


def scenes(spark: SparkSession, n: int, conditions: tuple[str, ...] = ("clear", "murky", "dark")) -> DataFrame:
    """Seeded synthetic images in the layout of read_images, with their condition and boxes."""

    def each(r: dict) -> list[dict]:
        i = r["id"]
        condition = conditions[i % len(conditions)]
        image, boxes = N.scene(i, condition, animals=i // 3 % 3)
        return [{"path": f"scene-{i}", "height": image.shape[0], "width": image.shape[1], "channels": 3, "data": image[..., ::-1].tobytes(), "condition": condition, "boxes": boxes}]

    return rows_to_rows(spark.range(n), each, "path string, height int, width int, channels int, data binary, condition string, boxes array<array<double>>")
