"""Quality rules: counts of each text, and repetition measured with a word-level suffix array.

The suffix array of a text orders its suffixes by prefix doubling, a batch of texts at once:
suffixes are ranked by their first word, and the ranks of those that tie are refined with the
ranks 1, 2, 4, ... words ahead until no two are equal. Words are ordered by numbers given to
their bytes; any fixed order serves. The ranks of all rounds also give the lengths of the common prefixes of
neighbours. Intervals of neighbours with a common prefix of at least MIN_REPEAT words are the
repeated substrings; every one extends to a maximal one, so the union of the maximal repeats'
spans is the union of what each suffix shares with its nearer neighbour. Texts in which no
MIN_REPEAT words come twice have no such interval, and their suffixes are not sorted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import documents, id_array, ids, map_texts, ragged, texts

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, repeat_cover long, longest_repeat long"

#: Words of the shortest repeat that counts, the percentage of a text that repeats may cover, and
#: the words of the longest repeat that a kept text may hold.
MIN_REPEAT, MAX_COVER, MAX_REPEAT = 10, 40, 100
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` over each of the ranges that `bounds` separates."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change)[:-1] > 0


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, words: K.Words) -> np.ndarray:
    """Lines of each text that have a word and equal an earlier line of it."""
    n = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    starts = starts[starts < len(data)]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, starts)], offsets[doc + 1])
    with_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends, doc = starts[with_word], ends[with_word], doc[with_word]
    _, first = np.unique(K.dense(doc, K.span_codes(data, starts, ends)[0]), return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


def suffix_repeats(codes: np.ndarray, first: np.ndarray, least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, words) of each suffix that shares at least `least` words with another of its text:
    the most it shares with any, which is what it shares with a neighbour in the suffix array.

    `codes` are numbers that equal words share. Hashes only choose the texts whose suffixes are sorted."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, gram = K.window_hashes(K.mix(codes.astype(K.U64)), first, least)
    if not len(at):
        return none
    doc = np.searchsorted(first, at, side="right") - 1
    key = K.mix(gram + doc.astype(K.U64) * K.U64(0xD1B54A32D192ED03))
    order = np.argsort(key)
    again = key[order[1:]] == key[order[:-1]]
    repeating = np.unique(doc[order[1:][again]])
    if not len(repeating):
        return none
    # the suffix arrays of the texts with a repeat, one after another
    sizes = np.diff(first)[repeating]
    word = ragged(first[:-1][repeating], sizes)
    n = len(word)
    end = np.repeat(np.cumsum(sizes), sizes)
    key = codes[word]
    order = np.lexsort((key, np.repeat(np.arange(len(sizes)), sizes)))
    rank, levels, width = np.zeros(n + 1, np.int64), [], 1
    tied = _refine(rank, order, [end[order], key[order]], np.zeros(n, np.int64))
    while len(tied):
        levels.append(rank.astype(np.int32))
        ahead = tied + width
        second = np.where(ahead < end[tied], rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[tied]))
        tied = _refine(rank, tied[order], [rank[tied[order]], second[order]], rank[tied[order]])
        width *= 2
    array = np.empty(n, np.int64)
    array[rank[:n]] = np.arange(n)
    left, right = array[:-1].copy(), array[1:].copy()
    stop_left, stop_right, shared = end[left], end[right], np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (left < stop_left) & (right < stop_right) & (stop_left == stop_right)
        same &= levels[k][left] == levels[k][right]
        step = same.astype(np.int64) << k
        shared += step
        left += step
        right += step
    most = np.maximum(np.r_[0, shared], np.r_[shared, 0])
    long = most >= least
    return word[array[long]], most[long]


def _refine(rank: np.ndarray, items: np.ndarray, keys: list[np.ndarray], base: np.ndarray) -> np.ndarray:
    """Give sorted `items` their new ranks, the place of the first equal one; returns those still tied.

    `base` is the rank that items shared so far, 0 at first; equal ones stand together.
    """
    m = len(items)
    new = np.ones(m, dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    outer = np.ones(m, dtype=bool)
    outer[1:] = base[1:] != base[:-1]
    place = np.arange(m)
    start = np.maximum.accumulate(np.where(new, place, 0))
    rank[items] = base + start - np.maximum.accumulate(np.where(outer, place, 0))
    alone = new & np.append(new[1:], True)
    return items[~alone]


def measure_batch(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = K.text_buffer(column)
    words = K.split_words(data, offsets)
    codes, _ = K.span_codes(data, words.start, words.end)
    n_words = words.counts
    inside = covered(words.start, words.end - words.start, len(data)) if len(words.start) else np.zeros(len(data), bool)
    out = {"n_words": n_words, "word_chars": per_text(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_text(SYMBOLS[data], offsets), "n_dup_lines": duplicate_lines(data, offsets, words)}
    at, gram = K.window_codes(codes, words.first, 3)
    own = K.dense(np.searchsorted(words.first, at, side="right") - 1, gram)
    out["n_repeat_words"] = per_text(covered(at[np.bincount(own)[own] > 1], 3, len(codes)), words.first)
    suffix, shared = suffix_repeats(codes, words.first)
    out["repeat_cover"] = per_text(covered(suffix, shared, len(codes)), words.first)
    longest = np.zeros(len(n_words), np.int64)
    np.maximum.at(longest, np.searchsorted(words.first, suffix, side="right") - 1, shared)
    out["longest_repeat"] = longest
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    out["kept"] = ~out["base_failed"] & (100 * out["repeat_cover"] <= MAX_COVER * n_words) & (longest <= MAX_REPEAT)
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of MEASURES for each document.

    repeat_cover is the number of words within repeats of at least MIN_REPEAT words, longest_repeat
    the words of the longest. A null or empty text has no words and fails the base rule.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = measure_batch(texts(batch))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeat_cover", "longest_repeat"]
            return pa.RecordBatch.from_arrays([id_array(ids(batch)), *[pa.array(found[x]) for x in names]], names=["doc_id", *names])

        return each

    return map_texts(documents(docs, id_col, text_col), make, MEASURES)
