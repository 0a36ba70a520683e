"""Bound-certified best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised in one narrow pass that keeps lengths and checksums only. Packing then
runs in rounds. In each, a partition packs its pieces best-fit decreasing and compares the
number of bins with a lower bound from dual feasible functions. Where the two agree the
partition is certified and keeps its bins, but for the least filled one; where they differ, it
opens a share of its bins, the emptiest. The pieces of opened bins are dealt to fewer
partitions, which pack them anew, until one partition has packed what was left.

Only piece lengths take part, so a partition of a million pieces needs a few tens of MB. A
round has a `fan_in`-th of the partitions of the one before and opens at most about a `fan_in`-th
of its bins, so partitions do not grow from round to round.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, id_array, ids, map_texts, materialize, ragged, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, group_bins long, group_bound long"
#: Pieces that a partition of the first round packs, for which their number is chosen.
GROUP_PIECES = 100_000
#: Distinct words whose ids a worker keeps; the memory of a worker's cache is bounded by it.
CACHE_WORDS = 500_000
#: Words tokenised at once, and bytes of text.
LEARN, SLICE_BYTES = 4096, 2 << 20
ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
ASCII_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])


class WordTokenizer:
    """Token ids of whole texts from the ids of their white-space separated words.

    Exact for tokenizers whose pre-tokenizer never lets a token cross ASCII white space and drops it.
    `check` reads that from the tokenizer's settings: its normalisers work within words, its first
    pre-tokenizer parts at white space and its added tokens hold none; and it tries each separator.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.check()
        self.clear()

    def check(self) -> None:
        """Refuse a tokenizer whose settings could join words, and see which texts may be simplified."""
        settings = json.loads(self.tok.to_str())
        steps = lambda key, inner: (x.get(inner, [x]) if (x := settings.get(key)) else [])
        normal, pre = steps("normalizer", "normalizers"), steps("pre_tokenizer", "pretokenizers")
        told = all(x["type"] in ("NFC", "NFD", "Lowercase", "BertNormalizer") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in normal)
        told &= bool(pre) and (pre[0]["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed")
        told &= not any(x["lstrip"] or x["rstrip"] or any(c.isspace() for c in x["content"]) for x in settings.get("added_tokens", ()))
        ids = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        if not told or any(ids(f"Ab{s}cd{s}{s}ef") != ids("Ab") + ids("cd") + ids("ef") for s in " \t\n\r\v\f"):
            raise ValueError("the tokenizer's ids depend on white space; words cannot be tokenised apart")
        marks = [chr(b) for b in range(33, 127) if ASCII_MARK[b]]
        self.simple = any(x["type"] == "Lowercase" for x in normal) and ids("aB") == ids("ab") and all(ids(f"ab{m}cd{m}{m}") == ids("ab") + ids(f"{m}cd") + ids(2 * m) for m in marks)

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.offset, self.length, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _learn(self, words: list[bytes]) -> None:
        made: list[list[int]] = []
        for at in range(0, len(words), LEARN):  # what the tokenizer tells of a word is far larger than its ids
            part = [w.decode("utf-8", "replace") for w in words[at : at + LEARN]]
            made += [x.ids for x in self.tok.encode_batch_fast(part, add_special_tokens=False)]
        n, sizes = len(self.known), np.fromiter(map(len, made), np.int64, len(made))
        total = int(sizes.sum())
        for name, need in (("offset", n + len(words)), ("length", n + len(words)), ("flat", self.used + total)):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.resize(have, max(need, 2 * len(have))))
        self.length[n : n + len(words)] = sizes
        self.offset[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.fromiter((i for x in made for i in x), np.uint32, total)
        self.used += total
        self.known.update(zip(words, range(n, n + len(words))))

    def _simplify(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The same ids from fewer distinct words: lower case, and punctuation apart from the word it ends.

        Upper case goes only where the next byte is ASCII, as a combining mark may make another
        character with it; an apostrophe stays, as contractions are tokens; texts that may hold
        special tokens stay as they are.
        """
        if not self.simple or len(data) < 2 or b"<|" in data.tobytes():
            return data, None
        plain = np.append(data[1:] < 128, True)
        letter = ASCII_LETTER[data]
        cut = np.zeros(len(data), dtype=bool)
        cut[1:] = letter[:-1] & ASCII_MARK[data[1:]]
        return np.where(plain, K.LOWER[data], data), cut

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids)."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        data, offsets = K.text_buffer(column)
        data, cut = self._simplify(data)
        words = K.split_words(data, offsets, cut=cut)
        if not len(words.start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        inverse, distinct = K.span_codes(data, words.start, words.end)
        distinct, known = distinct.to_pylist(), self.known
        if new := [w for w in distinct if w not in known]:
            self._learn(new)
        index = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))[inverse]
        lengths = self.length[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])[words.first[1:]]
        return self.flat[ragged(self.offset[index], lengths)], ends


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer, with its cache, for each worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of each document: its ids and then `end_id`, cut only where longer than `capacity`."""

    def make():
        tok = word_tokenizer(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, ends = tok.ids(texts(batch))
            counts = np.diff(ends, prepend=0) + 1
            full = np.full(len(flat) + len(ends), end_id, dtype="<u4")
            keep = np.ones(len(full), dtype=bool)
            stop = np.cumsum(counts)
            keep[stop - 1] = False
            full[keep] = flat
            parts = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), parts)
            piece = ragged(np.zeros(len(counts), np.int64), parts)
            start = piece * capacity
            length = np.minimum(counts[doc] - start, capacity)
            begin = (stop - counts)[doc] + start
            raw = memoryview(full.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            return pa.RecordBatch.from_arrays(
                [id_array(ids(batch)[doc]), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

        return each

    return map_texts(documents(docs, id_col, text_col), make, PIECES, size=SLICE_BYTES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, from dual feasible functions. counts[x]: items of length x.

    The volume bound is the identity function. For each threshold k up to half the capacity, the
    function that maps x > C - k to C, k <= x <= C - k to itself and smaller x to 0 is dual
    feasible, as is rounding down to multiples of 1 / q: x becomes floor(x * (q + 1) / C) / q, or
    stays x / C where x * (q + 1) / C is whole.
    """
    sizes = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    volume = sizes * counts
    best = -(-int(volume.sum()) // capacity)
    many, mass = np.cumsum(counts[::-1])[::-1], np.cumsum(volume)
    for k in range(1, capacity // 2 + 1):
        large = int(many[capacity - k + 1]) if capacity - k + 1 < len(many) else 0
        middle = int(mass[min(capacity - k, len(mass) - 1)] - mass[k - 1])
        best = max(best, large - (-middle // capacity))
    for q in range(1, 65):
        scaled = sizes * (q + 1)
        share = np.where(scaled % capacity == 0, sizes * q, scaled // capacity * capacity)
        best = max(best, -(-int((share * counts).sum()) // (capacity * q)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin: longest first into the fullest bin with room."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    fills: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            b, left = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left -= size
        if left:
            if not room[left]:
                open_rooms |= 1 << left
            room[left].append(b)
    return bins, offsets, np.asarray(fills, dtype=np.int64)


def pack_round(part: pa.Table, capacity: int, number: int, last: bool, fan_in: int) -> pa.Table:
    """Pack one partition; `open` marks the pieces that go to the next round."""
    order = np.lexsort((part["piece"].to_numpy(), ids(part)))
    part = part.take(pa.array(order))
    lengths = part["length"].to_numpy()
    bins, offsets, fills = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    opened = np.zeros(len(fills), dtype=bool)
    if not last:
        share = 1 if len(fills) <= bound else 1 + len(fills) // fan_in
        emptiest = np.argsort(fills, kind="stable")[:share]
        opened[emptiest[fills[emptiest] < capacity]] = True
    group = int(part["part"][0].as_py())
    made = {"sequence_id": (np.int64(number) << np.int64(58)) + (np.int64(group) << np.int64(32)) + bins, "offset": offsets, "group_bins": np.full(len(bins), len(fills)), "group_bound": np.full(len(bins), bound), "open": opened[bins]}
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return pa.table([*[part[c] for c in names], *map(pa.array, made.values())], names=[*names, *made])


def _packer(capacity: int, number: int, last: bool, fan_in: int) -> Callable[[pa.Table], pa.Table]:
    return lambda part: pack_round(part, capacity, number, last, fan_in)


def pack(pieces: DataFrame, capacity: int = 2048, groups: int | None = None, fan_in: int = 8) -> DataFrame:
    """Place `pieces` (PIECES, none longer than capacity) in sequences.

    Returns PACKED rows. group_bins is the number of bins that the partition which placed a piece made
    of all it had, group_bound the certified least number; where they are equal no packing is better.
    `groups` is the number of partitions of the first round, by default one for GROUP_PIECES pieces;
    each round deals what is open to a `fan_in`-th of them.
    """
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "group_bins": F.lit(1).cast("long"), "group_bound": F.lit(1).cast("long")})
    rest, done, number = pieces.where(F.col("length") < capacity), [], 1
    groups = groups or max(1, -(-rest.count() // GROUP_PIECES))
    spread = lambda n: F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(n)).cast("int")
    while True:
        last = groups <= 1
        dealt = rest.withColumn("part", spread(groups)).groupBy("part")
        packed = materialize(dealt.applyInArrow(_packer(capacity, number, last, fan_in), f"{PACKED}, open boolean"), f"packed-{number}")
        done.append(packed.where(~F.col("open")).drop("open"))
        rest = packed.where("open").select("doc_id", "piece", "start", "length", "ids_crc32")
        if last:
            break
        groups, number = max(1, groups // fan_in), number + 1
    out = full
    for x in done:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise documents and pack them: PACKED rows, one for each piece.

    A null or empty text is the end id alone. Rows that repeat a doc_id are packed separately.
    """
    made = materialize(token_pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack(made, capacity)
