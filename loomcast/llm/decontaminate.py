"""Benchmark decontamination by spaced-seed hashing.

A window of WINDOW consecutive tokens of a benchmark item leaks into a document if a window of
the document has the same tokens at all but at most ALLOWED places. Three fixed masks, each of
seven places within at most eleven, hash only the tokens at their places; whichever two of
thirteen places are substituted, one mask at some shift avoids both, so hashing finds every
such window. Around each hit, the windows that hold the seed are compared token by token.

Items shorter than a window are matched as a whole: with one substitution from six tokens on
(one half of the item is then intact and serves as seed), else exactly.

Tokens are lower-cased runs of letters, digits and non-ASCII characters.

Each distinct window of the benchmark is indexed once, with the list of its items apart, and seeds
that lie alike in the same windows are one seed. So a prompt that thousands of items share is
compared once. Verification goes in steps of a bounded number of comparisons.

The benchmark is the stated query set. It is split into blocks of a bounded size, each of which is
broadcast. One block is searched for in one narrow pass over the documents. More blocks mean a pass
each, so that a worker holds one block at a time; only the documents that leak are then joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, id_array, ids, map_texts, materialize, ragged, rewrite_texts, texts, unused
from .overlap import merge

WINDOW, ALLOWED = 13, 2
#: Places of the masks that together survive any two substitutions in a window.
MASKS = ((0, 1, 2, 4, 5, 6, 7), (0, 1, 2, 3, 6, 9, 10), (0, 2, 3, 4, 5, 6, 7))
#: Bytes of benchmark text that one broadcast block holds at most, but for a longer single item.
BLOCK_BYTES = 8 << 20
FILTER_BITS = 22
#: Hits that are verified at once.
STEP = 1 << 17

SPANS = "doc_id long, n_tokens long, n_leaked long, item_ids array<long>, spans array<int>, contaminated boolean"


@dataclass
class Seeds:
    """Seeds of one mask for windows of one length, sorted by hash."""

    mask: tuple[int, ...]
    window: int
    allowed: int
    numbers: tuple[int, int]
    hashes: np.ndarray
    place: np.ndarray
    maybe: np.ndarray


@dataclass
class Block:
    """A block of benchmark items, indexed. `whole[p]` is the distinct window that begins at token p,
    or -1; the items of window x are items[first_item[x]:first_item[x + 1]]."""

    item_ids: np.ndarray
    tokens: np.ndarray
    whole: np.ndarray
    items: np.ndarray
    first_item: np.ndarray
    seeds: list[Seeds]


def tokens(column: pa.Array) -> K.Words:
    data, offsets = K.text_buffer(column)
    return K.split_words(K.fold(data), offsets, K.PUNCTUATION)


def masked_hashes(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash under `mask` at each place where the mask fits into all tokens."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, K.U64)
    out = np.zeros(n, K.U64)
    for i in mask:
        out = (out ^ hashes[i : i + n]) * K.U64(0x9DDFEA08EB382D69)
        out ^= out >> K.U64(29)
    return out


def plan(length: int) -> list[tuple[tuple[int, ...], int, int]]:
    """(mask, window, substitutions allowed) by which items of so many tokens are searched."""
    if length >= WINDOW:
        return [(m, WINDOW, ALLOWED) for m in MASKS]
    if length < 6:
        return [(tuple(range(length)), length, 0)] if length else []
    half = length // 2
    return [(tuple(range(half)), length, 1), (tuple(range(length - half)), length, 1)]


def index(item_ids: np.ndarray, column: pa.Array) -> Block:
    words = tokens(column)
    hashes = K.word_hashes(words)
    codes, _ = K.span_codes(words.data, words.start, words.end)
    wanted: dict[tuple[tuple[int, ...], int, int], list[int]] = {}
    for item, n in enumerate(words.counts.tolist()):
        for key in plan(n):
            wanted.setdefault(key, []).append(item)
    whole, items, sizes, numbers = np.full(len(hashes) + 1, -1, np.int32), [], [np.zeros(1, np.int64)], {}
    known = 0
    for window in sorted({w for _, w, _ in wanted}):  # the windows of an item have one length
        own = np.asarray(sorted({i for (_, w, _), x in wanted.items() if w == window for i in x}))
        counts = words.counts[own] - window + 1
        at, number = ragged(words.first[:-1][own], counts), _window_numbers(codes, words.first, own, window)
        pair = np.unique(number * len(item_ids) + np.repeat(own, counts))  # an item has a window once
        n = int(number.max()) + 1
        items.append(pair % len(item_ids))
        sizes.append(np.bincount(pair // len(item_ids), minlength=n))
        whole[at] = number + known
        numbers[window] = (known, known + n)
        known += n
    seeds = []
    for (mask, window, allowed), own in wanted.items():
        own = np.asarray(own)
        counts = words.counts[own] - mask[-1]
        place = ragged(words.first[:-1][own], counts)
        within = ragged(np.zeros(len(own), np.int64), counts)
        # of places that the mask has in the same windows, one
        windows = [np.where(within >= shift, whole[np.maximum(place - shift, 0)], -1) for shift in range(window - mask[-1])]
        order = np.lexsort(windows)
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in windows], axis=0)
        place = place[order[new]]
        made = masked_hashes(hashes, mask)[place]
        order = np.argsort(made, kind="stable")
        maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        maybe[made & K.U64((1 << FILTER_BITS) - 1)] = True
        seeds.append(Seeds(mask, window, allowed, numbers[window], made[order], place[order], maybe))
    return Block(item_ids, hashes, whole, np.concatenate([np.zeros(0, np.int64), *items]), np.cumsum(np.concatenate(sizes)), seeds)


def _window_numbers(codes: np.ndarray, first: np.ndarray, own: np.ndarray, window: int) -> np.ndarray:
    """A number for the tokens of each window of the items `own`, equal for equal tokens."""
    counts = first[own + 1] - first[own]
    words = ragged(first[own], counts)
    return K.window_codes(codes[words], np.concatenate([[0], np.cumsum(counts)]), window)[1]


def leaks(hashes: np.ndarray, first: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, tokens, item) of each window of the texts that an item of the block leaks into."""
    start, size, window = leaking_windows(hashes, first, block)
    many = block.first_item[window + 1] - block.first_item[window]
    start, size, item = np.repeat(start, many), np.repeat(size, many), block.items[ragged(block.first_item[window], many)]
    _, once = np.unique(np.stack([start, size, item]), axis=1, return_index=True)
    return start[once], size[once], item[once]


def leaking_windows(hashes: np.ndarray, first: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, tokens, distinct window) of each window of the texts that is in the block, in order."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = K.U64((1 << FILTER_BITS) - 1)
    for s in block.seeds:
        made = masked_hashes(hashes, s.mask)
        at = np.flatnonzero(s.maybe[made & low])
        if not len(at):
            continue
        left = np.searchsorted(s.hashes, made[at], "left")
        hits = np.searchsorted(s.hashes, made[at], "right") - left
        at, hits, left = at[hits > 0], hits[hits > 0], left[hits > 0]
        doc = np.searchsorted(first, at, side="right") - 1
        inside = at + s.mask[-1] < first[doc + 1]
        at, hits, left, doc = at[inside], hits[inside], left[inside], doc[inside]
        ends = np.cumsum(hits)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, STEP):  # bounds the memory of verification
            one = np.arange(lo, min(lo + STEP, int(ends[-1])))
            row = np.searchsorted(ends, one, side="right")
            place = s.place[left[row] + one - (ends - hits)[row]]
            found.append(_verified(hashes, first, block, s, at[row], doc[row], place))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, size, window = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((window, start))
    once = np.ones(len(order), dtype=bool)
    once[1:] = (start[order[1:]] != start[order[:-1]]) | (window[order[1:]] != window[order[:-1]])
    once = order[once]
    return start[once], size[once], window[once]


def _verified(hashes, first, block, s, at, doc, place):
    """Compare the windows around each hit: those that hold the seed and lie within text and item."""
    starts, windows = [], []
    for shift in range(s.window - s.mask[-1]):
        a, p = at - shift, place - shift
        number = np.where(p >= 0, block.whole[p], -1)
        fits = (a >= first[doc]) & (a + s.window <= first[doc + 1]) & (number >= s.numbers[0]) & (number < s.numbers[1])
        a, p, number = a[fits], p[fits], number[fits]
        differ = np.zeros(len(a), np.int8)
        for i in range(s.window):
            differ += hashes[a + i] != block.tokens[p + i]
        good = differ <= s.allowed
        pair = np.unique(np.stack([a[good], number[good]]), axis=1)
        starts.append(pair[0])
        windows.append(pair[1])
    start = np.concatenate(starts)
    return start, np.full(len(start), s.window), np.concatenate(windows)


class Items:
    """The item ids of sets of windows. Documents that hold the same passage have the same set."""

    def __init__(self, block: Block):
        self.block, self.known = block, {}

    def of(self, windows: np.ndarray) -> list[int]:
        windows = np.unique(windows)
        key = windows.tobytes()
        if key not in self.known:
            if len(self.known) >= 256:
                self.known.clear()
            first = self.block.first_item
            rows = np.unique(self.block.items[ragged(first[windows], first[windows + 1] - first[windows])])
            self.known[key] = np.unique(self.block.item_ids[rows]).tolist()
        return self.known[key]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast handles of the indexed benchmark, in blocks of a bounded size.

    Only sums come to the driver before the blocks do, and one block at a time is held there.
    """
    spark = benchmark.sparkSession
    items = documents(benchmark, id_col, text_col)
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_bytes))
    out = []
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == k).toArrow().combine_chunks()
        if part.num_rows:
            out.append(spark.sparkContext.broadcast(index(ids(part), texts(part))))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row of SPANS for each document.

    n_leaked counts tokens within leaked windows, `spans` lists their ranges as first, end, first,
    end, ... in tokens, item_ids the items they come from, ascending. A document is contaminated if
    any window leaks. Null and empty texts and an empty benchmark give no leak; items without
    tokens match nothing.
    """
    shared = blocks(benchmark, block_bytes=block_bytes)
    own = documents(docs, id_col, text_col)
    if len(shared) < 2:
        return map_texts(own, _scanner(shared[0] if shared else None), SPANS)
    keyed = own.withColumn("text_key", F.xxhash64("text"))
    said = [map_texts(keyed, _scanner(b, True), f"{SPANS}, text_key long") for b in shared]
    found = said[0]
    for x in said[1:]:
        found = found.unionByName(x)
    # copies of a row say the same; the spans of blocks are united
    found = materialize(found.distinct(), "leaks").groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    found = found.mapInArrow(_united, "doc_id long, text_key long, n_leaked long, spans array<int>, item_ids array<long>")
    counted = map_texts(keyed, _counter, "doc_id long, text_key long, n_tokens long").alias("d")
    both = counted.join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key")), "left")
    none = lambda t: F.array().cast(f"array<{t}>")
    return both.select("d.doc_id", "n_tokens", F.coalesce("n_leaked", F.lit(0)).cast("long").alias("n_leaked"), F.coalesce("item_ids", none("long")).alias("item_ids"), F.coalesce("spans", none("int")).alias("spans"), F.col("n_leaked").isNotNull().alias("contaminated"))


def _scanner(shared, keyed: bool = False):
    """A function that searches texts for a block; `keyed`: it says only what leaks, with text_key."""

    def make():
        block = shared.value if shared is not None else None
        items = Items(block) if block is not None else None

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = tokens(texts(batch))
            hashes = K.word_hashes(words)
            start, size, window = leaking_windows(hashes, words.first, block) if block is not None else (np.zeros(0, np.int64),) * 3
            change = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + size, -1)
            covered = np.cumsum(change)[:-1] > 0
            sums = np.concatenate([[0], np.cumsum(covered)])
            leaked = sums[words.first[1:]] - sums[words.first[:-1]]
            doc = np.searchsorted(words.first, start, side="right") - 1
            found: dict[int, list] = {}
            with_leaks, at = np.unique(doc, return_index=True)  # starts are sorted
            for d, own in zip(with_leaks.tolist(), np.split(window, at[1:])):
                inside = covered[words.first[d] : words.first[d + 1]].astype(np.int8)
                found[d] = [items.of(own), np.flatnonzero(np.diff(inside, prepend=0, append=0)).tolist()]
            n = batch.num_rows
            out = pa.RecordBatch.from_arrays(
                [
                    id_array(ids(batch)),
                    pa.array(words.counts, pa.int64()),
                    pa.array(leaked, pa.int64()),
                    pa.array([found[i][0] if i in found else [] for i in range(n)], pa.list_(pa.int64())),
                    pa.array([found[i][1] if i in found else [] for i in range(n)], pa.list_(pa.int32())),
                    pa.array(leaked > 0),
                ],
                names=["doc_id", "n_tokens", "n_leaked", "item_ids", "spans", "contaminated"],
            )
            return out.append_column("text_key", batch.column("text_key")).filter(pa.array(leaked > 0)) if keyed else out

        return each

    return make


def _counter():
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([id_array(ids(batch)), batch.column("text_key"), pa.array(tokens(texts(batch)).counts, pa.int64())], names=["doc_id", "text_key", "n_tokens"])

    return each


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        merged = []
        for lists in batch.column("spans").to_pylist():
            pairs = np.array([x for one in lists for x in one], np.int64).reshape(-1, 2)
            begin, end = merge(pairs[:, 0], pairs[:, 1] - pairs[:, 0])
            merged.append(np.stack([begin, end], axis=1).ravel())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array([int((m[1::2] - m[::2]).sum()) for m in merged], pa.int64()), pa.array([m.tolist() for m in merged], pa.list_(pa.int32())), batch.column("item_ids")],
            names=["doc_id", "text_key", "n_leaked", "spans", "item_ids"],
        )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, into which no benchmark item leaks."""
    shared = blocks(benchmark, block_bytes=block_bytes)
    if len(shared) > 1:
        name, row = unused(docs, "text_key", "doc_id")
        key = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
        found = scan(docs.select(key.alias(row), F.col(f"`{text_col}`").alias("text")), benchmark, row, "text", block_bytes)
        leaking = found.where("contaminated").select(F.col("doc_id").alias(name)).distinct()
        return docs.withColumn(name, key).join(leaking, name, "left_anti").drop(name)

    def make():
        block = shared[0].value if shared else None

        def each(column: pa.Array) -> np.ndarray:
            keep = np.ones(len(column), dtype=bool)
            if block is not None:
                words = tokens(column)
                start, _, _ = leaking_windows(K.word_hashes(words), words.first, block)
                keep[np.searchsorted(words.first, start, side="right") - 1] = False
            return keep

        return each

    return rewrite_texts(docs, make, text_col)
