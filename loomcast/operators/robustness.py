"""Sweeps over degradations, and pictures as a model takes them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import degrade as G
from ..functions import kernels as N
from ..functions import masks
from . import metrics, sampling
from .images import rows_to_rows, to_array
from .selection import robustness_grid

PICTURE = "path string, height int, width int, channels int, data binary"


def as_row(path: str, image: np.ndarray) -> dict:
    return {"path": path, "height": image.shape[0], "width": image.shape[1], "channels": 3, "data": np.ascontiguousarray(image[..., ::-1]).tobytes()}


def seed_of(path: str) -> int:
    return zlib.crc32(path.encode())


def sweep_base(rows: DataFrame, id_col: str, least: int = 50, most: int = 800, seed: int = 0) -> DataFrame:
    """The rows a sweep degrades: clear ones if there are enough, else all; at most `most`, by hash."""
    clear = rows.where("slice = 'clear'")
    base = clear if clear.limit(least).count() >= least else rows
    return sampling.uniform(base, C.hash01(seed, "robustness", F.col(id_col)), id_col, most)


def degraded(pictures: DataFrame, groups: Sequence[str] = tuple(G.GROUPS), levels: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Decoded pictures under each group of operations at each level: PICTURE, operation and level. A
    level is a severity in fifths; the scene of a picture is the same in all of them."""

    def each(row: dict) -> list[dict]:
        image = to_array(row["height"], row["width"], row["channels"], row["data"])
        made = G.degrade(image, G.GROUPS[row["operation"]], row["level"] / 5, seed_of(row["path"]))
        return [as_row(row["path"], made) | {"operation": row["operation"], "level": int(row["level"])}]

    settings = robustness_grid(pictures.select("path", "height", "width", "channels", "data"), groups, levels)
    return rows_to_rows(settings, each, f"{PICTURE}, operation string, level int")


def sweep(pictures: DataFrame, truth: DataFrame, score: Callable[[np.ndarray], float], groups: Sequence[str] = tuple(G.GROUPS), levels: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """(operation, level, n, n_pos, auc) of a scorer of pictures; truth is (path, y)."""

    def each(row: dict) -> list[dict]:
        return [{"path": row["path"], "operation": row["operation"], "level": row["level"], "score": float(score(to_array(row["height"], row["width"], row["channels"], row["data"])))}]

    scored = rows_to_rows(degraded(pictures, groups, levels), each, "path string, operation string, level int, score double")
    return metrics.roc_auc(scored.join(truth.select("path", "y"), "path"), "y", "score", ["operation", "level"])


def training_views(pictures: DataFrame, mode: str = "context_only", epoch: int = 0) -> DataFrame:
    """(path, view, picture): what a model sees and what it predicts, of each decoded picture."""

    def each(row: dict) -> list[dict]:
        image = to_array(row["height"], row["width"], row["channels"], row["data"])
        both = G.views(image, mode, seed_of(f"{epoch}|{row['path']}"))
        return [as_row(row["path"], x) | {"view": name} for name, x in zip(("context", "target"), both)]

    return rows_to_rows(pictures.select("path", "height", "width", "channels", "data"), each, f"{PICTURE}, view string")


def random_crops(pictures: DataFrame, rows: int, cols: int, epoch: int = 0, flip: float = 0.0) -> DataFrame:
    """PICTURE of a random crop of each picture, resized; the crop is drawn from the path and the epoch."""

    def each(row: dict) -> list[dict]:
        image = to_array(row["height"], row["width"], row["channels"], row["data"])
        seed = seed_of(f"{epoch}|{row['path']}")
        top, left, h, w = masks.crop_window(image.shape[1], image.shape[0], seed)
        made = N.resize(image[top : top + h, left : left + w], rows, cols).round().clip(0, 255).astype(np.uint8)
        return [as_row(row["path"], made[:, ::-1] if np.random.default_rng([seed, 7]).random() < flip else made)]

    return rows_to_rows(pictures.select("path", "height", "width", "channels", "data"), each, PICTURE)


def yuv420_to_rgb(planes: np.ndarray, width: int, height: int) -> np.ndarray:
    """A picture of a camera's planar buffer, rows of any stride: all brightness, then the two colour
    planes of half the size."""
    stride = planes.shape[1]
    colour = np.asarray(planes[height:], dtype=np.float64).reshape(-1)[: height * stride // 2].reshape(2, height // 2, stride // 2)
    u, v = colour.repeat(2, 1).repeat(2, 2)[:, :height, :width] - 128
    y = np.asarray(planes[:height, :width], dtype=np.float64)
    return (y[..., None] + np.stack([1.402 * v, -0.344136 * u - 0.714136 * v, 1.772 * u], -1)).clip(0, 255).astype(np.uint8)


def shrink_to(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """A picture resized without aliasing: averaged over whole blocks about its centre, then bilinear."""
    factors = [max(1, n // m) for n, m in zip(image.shape, (rows, cols))]
    inner = image[tuple(slice(n % f // 2, n % f // 2 + n // f * f) for n, f in zip(image.shape, factors))].astype(np.float64)
    for axis, f in enumerate(factors):
        inner = np.add.reduceat(inner, np.arange(0, inner.shape[axis], f), axis) / f
    return (N.resize(np.floor(inner + 0.5), rows, cols) + 0.5).clip(0, 255).astype(np.uint8)


def model_input(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """(3, rows, cols) of 0 to 1."""
    fitted = image if image.shape[:2] == (rows, cols) else shrink_to(image, rows, cols)
    return np.moveaxis(fitted, -1, 0).astype(np.float32) / 255


def one_field(image: np.ndarray) -> np.ndarray:
    """Every other row of an interlaced picture, which then is half as high as it should be shown."""
    return image[::2]


def saved_size(width: int, height: int, field: bool, short_side: int = 288) -> tuple[int, int]:
    """(width, height) of a frame as it is kept: of its true shape, its short side at most `short_side`."""
    true = height * (2 if field else 1)
    scale = min(1.0, short_side / min(width, true))
    return max(1, round(width * scale)), max(1, round(true * scale))


def spread_times(duration: float, n: int = 16) -> list[float]:
    """The middles of n equal parts of a video, where it is looked at for lettering."""
    return [duration * (i + 0.5) / n for i in range(n)]


def video_frames(frames: DataFrame, bands: tuple[float, float] = (0.0, 0.0), fps: float = 1.0, bits: int = 5, distance: float = 1.0, short_side: int = 288) -> DataFrame:
    """The frames of videos that are kept, from decoded ones (video, t, interlaced, PICTURE columns).

    Interlaced frames keep one field and all lose the lettered `bands` at top and bottom; frames come
    at `fps` at most, and one that is like the last kept, by hash and thumbnail, goes. A video is
    one group, read in order with one frame in memory.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from ..streaming.machines import Gate

    kind = _parse_datatype_string(f"video string, t double, phash long, {PICTURE}")

    def run(batches):
        arrow, now, gate, last = to_arrow_schema(kind), object(), None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["video"] != now:
                    now, gate, last = row["video"], Gate(fps, bits), None
                if gate.step({"t": row["t"], "hash": None})["why"] == "rate":
                    continue
                image = to_array(row["height"], row["width"], row["channels"], row["data"])
                image = one_field(image) if row["interlaced"] else image
                h = image.shape[0]
                image = image[round(bands[0] * h) : h - round(bands[1] * h)]
                known = N.perceptual_hash(image), N.thumbnail(image)
                if last is not None and ((last[0] ^ known[0]) & (1 << 64) - 1).bit_count() <= bits and N.thumbnail_distance(last[1], known[1]) <= distance:
                    continue
                last = known
                w, h = saved_size(image.shape[1], image.shape[0], row["interlaced"], short_side)
                small = N.resize(image, h, w).round().clip(0, 255).astype(np.uint8)
                yield pa.RecordBatch.from_pylist([{"video": now, "t": row["t"], "phash": known[0], **as_row(f"{now}_t{row['t']:09.2f}.jpg".replace("/", "_"), small)}], schema=arrow)

    return frames.repartition(F.col("video")).sortWithinPartitions("video", "t").mapInArrow(run, kind)


def overlay_of(frames: DataFrame, band: float = 0.18, width: int = 160) -> DataFrame:
    """(video, top, bottom): the shares of the height that lettering takes, from the decoded frames at
    spread_times of each video, of which there are a few."""
    import pandas as pd

    def each(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        gray = [to_array(*r).mean(-1) / 255 for r in part.sort_values("t")[["height", "width", "channels", "data"]].itertuples(index=False)]
        rows = [N.resize(g, max(2, round(g.shape[0] * width / g.shape[1])), width) for g in gray]
        top, bottom = N.overlay_bands(np.stack(rows), band)
        return pd.DataFrame({"video": [key[0]], "top": [top], "bottom": [bottom]})

    return frames.select("video", "t", "height", "width", "channels", "data").groupBy("video").applyInPandas(each, "video string, top double, bottom double")


def coverage_of_masks(rows: int, cols: int, batches: int, spark: SparkSession, size: int = 64, seed: int = 0) -> DataFrame:
    """(cell, target, context): how often a sample has each cell as either, over `batches` batches."""

    def each(row: dict) -> list[dict]:
        context, target = masks.block_masks(size, rows, cols, seed + row["id"])
        count = lambda x: np.bincount(x.ravel(), minlength=rows * cols).tolist()
        return [{"cell": i, "t": t, "c": c} for i, (t, c) in enumerate(zip(count(target), count(context)))]

    cells = rows_to_rows(spark.range(batches), each, "cell int, t long, c long")
    return cells.groupBy("cell").agg((F.sum("t") / (size * batches)).alias("target"), (F.sum("c") / (size * batches)).alias("context"))


def ingest(pictures: DataFrame, stored: DataFrame, short_side: int = 384) -> DataFrame:
    """Decoded pictures that are not stored yet, by path, their short side at most `short_side`, with the
    size they had (full_height, full_width). None is enlarged."""

    def each(row: dict) -> list[dict]:
        image = to_array(row["height"], row["width"], row["channels"], row["data"])
        w, h = saved_size(image.shape[1], image.shape[0], False, short_side)
        small = image if (h, w) == image.shape[:2] else N.resize(image, h, w).round().clip(0, 255).astype(np.uint8)
        return [as_row(row["path"], small) | {"full_height": row["height"], "full_width": row["width"]}]

    new = pictures.join(stored.select("path"), "path", "left_anti").select("path", "height", "width", "channels", "data")
    return rows_to_rows(new, each, f"{PICTURE}, full_height int, full_width int")


def fit_mask(mask: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """A mask of 0 and 1 at another size, each cell that of the nearest pixel."""
    at = [((np.arange(m) + 0.5) * n / m).astype(int) for n, m in zip(np.shape(mask)[:2], (rows, cols))]
    return (np.asarray(mask)[np.ix_(*at)] > 0).astype(np.uint8)
