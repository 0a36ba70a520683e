"""Random crops and block masks of grids, drawn for many samples at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def crop_window(width: int, height: int, seed: int, scale: tuple[float, float] = (0.3, 1.0), ratio: tuple[float, float] = (3 / 4, 4 / 3), tries: int = 10) -> tuple[int, int, int, int]:
    """(top, left, height, width) of a random crop of a share `scale` of the area and an aspect `ratio`;
    the first of `tries` draws that fits, else the largest centred one of an allowed aspect."""
    rng = np.random.default_rng(seed)
    area = width * height * rng.uniform(*scale, tries)
    aspect = np.exp(rng.uniform(*np.log(ratio), tries))
    sides = np.rint(np.sqrt(np.stack([area / aspect, area * aspect]))).astype(int)  # heights, widths
    fits = np.flatnonzero(((sides > 0) & (sides <= [[height], [width]])).all(0))
    if len(fits):
        h, w = sides[:, fits[0]].tolist()
        top, left = rng.integers(0, [height - h + 1, width - w + 1])
        return int(top), int(left), h, w
    shape = float(np.clip(width / height, *ratio))
    h, w = min(height, round(width / shape)), min(width, round(height * shape))
    return (height - h) // 2, (width - w) // 2, h, w


@dataclass(frozen=True)
class Blocks:
    """Sizes of context and target blocks as shares of a grid, and what a context must keep."""

    context: tuple[float, float] = (0.85, 1.0)
    target: tuple[float, float] = (0.15, 0.2)
    aspect: tuple[float, float] = (0.75, 1.5)
    targets: int = 4
    keep: int = 10
    overlap: bool = False
    tries: int = 20


def _sides(share: float, aspect: float, rows: int, cols: int) -> tuple[int, int]:
    area = rows * cols * share
    return int(np.clip(round((area * aspect) ** 0.5), 1, rows)), int(np.clip(round((area / aspect) ** 0.5), 1, cols))


def _placed(rng: np.random.Generator, n: int, h: int, w: int, rows: int, cols: int) -> np.ndarray:
    """n blocks of h x w at random places, as (n, rows, cols)."""
    top, left = rng.integers(0, [rows - h + 1, cols - w + 1], (n, 2)).T[:, :, None]
    r, c = np.arange(rows)[None], np.arange(cols)[None]
    return (((r - top) >= 0) & ((r - top) < h))[:, :, None] & (((c - left) >= 0) & ((c - left) < w))[:, None]


def block_masks(n: int, rows: int, cols: int, seed: int, blocks: Blocks = Blocks()) -> tuple[np.ndarray, np.ndarray]:
    """(context cells (n, k), target cells (n, targets, m)) of n samples, by the number of the cell.

    All samples share the sizes of their blocks. A context is a block less the targets; one that keeps
    too little is drawn again, and after `tries` it may overlap them. Contexts are cut at random to the
    length of the shortest.
    """
    rng = np.random.default_rng(seed)
    h, w = _sides(rng.uniform(*blocks.target), rng.uniform(*blocks.aspect), rows, cols)
    targets = np.stack([_placed(rng, n, h, w, rows, cols) for _ in range(blocks.targets)], 1)
    size = _sides(rng.uniform(*blocks.context), rows / cols, rows, cols)
    free = np.ones((n, rows, cols), bool) if blocks.overlap else ~targets.any(1)
    context = np.zeros((n, rows, cols), bool)
    open_ = np.arange(n)
    for _ in range(blocks.tries):
        drawn = _placed(rng, len(open_), *size, rows, cols) & free[open_]
        good = drawn.sum((1, 2)) >= blocks.keep
        context[open_[good]] = drawn[good]
        open_ = open_[~good]
        if not len(open_):
            break
    context[open_] = _placed(rng, len(open_), *size, rows, cols)
    flat = context.reshape(n, -1)
    k = int(flat.sum(1).min()) if n else 0
    score = np.where(flat, rng.random(flat.shape), -1.0)
    cells = np.sort(np.argsort(-score, axis=1)[:, :k], axis=1)
    return cells, np.nonzero(targets.reshape(n * blocks.targets, -1))[1].reshape(n, blocks.targets, h * w)


def mask_frequencies(rows: int, cols: int, seed: int, batches: int = 50, size: int = 64, blocks: Blocks = Blocks()) -> tuple[np.ndarray, np.ndarray]:
    """(targets, contexts) a sample has on each cell, on average."""
    target, context = np.zeros(rows * cols), np.zeros(rows * cols)
    for k in range(batches):
        c, t = block_masks(size, rows, cols, seed + k, blocks)
        context += np.bincount(c.ravel(), minlength=rows * cols)
        target += np.bincount(t.ravel(), minlength=rows * cols)
    return (target / batches / size).reshape(rows, cols), (context / batches / size).reshape(rows, cols)
