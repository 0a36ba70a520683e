"""Vectorised text kernels shared by the corpus operators.

All of them work on a batch of texts as one UTF-8 byte buffer, so a batch of a few
megabytes costs a handful of numpy passes and no Python loop over words.

Words are runs of bytes other than 0x20 and 0x09-0x0D; these are single bytes in UTF-8, so
splitting bytes and splitting characters agree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: All ASCII but letters and digits separates; bytes of other characters belong to words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII letters and for the Latin-1 letters of two UTF-8 bytes."""
    out = LOWER[data]
    if len(out) > 1:
        latin = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][latin] += 32
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
_powers: dict[int, list[np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n, kept for the process and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        both = []
        for b in (base & _MASK, pow(base, -1, 1 << 64)):
            out = np.ones(size, dtype=U64)
            done, step = 1, b
            while done < size:
                take = min(done, size - done)
                out[done : done + take] = out[:take] * U64(step)
                done += take
                step = step * step & _MASK
            both.append(out)
        _powers[base] = have = both
    return have[0], have[1]


def prefix_hash(values: np.ndarray, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which range_hash takes the hash of any range of `values` (uint64)."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def range_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums, down = prefix
    return (sums[end] - sums[start]) * down[start]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch of texts. `first[i]:first[i + 1]` are the words of text i."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def split_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR, cut: np.ndarray | None = None) -> Words:
    """Words of each text; `cut` marks bytes before which a word ends and another begins."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(data, offsets, empty, empty, np.zeros(len(offsets), np.int64))
    inside = ~separator[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    if cut is not None:
        begins |= cut & inside
        ends[:-1] |= cut[1:] & inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[cuts] = inside[cuts]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[lasts] = inside[lasts]
    start = np.flatnonzero(begins)
    return Words(data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


#: Where hashes of words start, for the first and the second hash.
_STARTS = (0x9AE16A3B2F90404F, 0xC949C7DEFB2C1D57)
#: Bytes up to which a word is hashed eight bytes at a time; longer ones go through BLAKE2.
LANED = 256
_LANE_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each range of bytes; `second` gives an independent one.

    Eight bytes at a time go through `mix`, which is no polynomial: sequences that polynomials modulo
    2**64 confuse whatever their base, such as the Thue-Morse sequence and its complement, differ here.
    """
    begin = U64(_STARTS[second])
    size = end - start
    out = mix(size.astype(U64) * U64(_ODD) ^ begin)
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    long = np.flatnonzero(size > LANED)
    short = np.flatnonzero(size <= LANED) if len(long) else None
    at, left, h = (start, size, out) if short is None else (start[short], size[short], out[short])
    rows = np.arange(len(at))
    done = 0
    while len(rows):
        lane = eights[at[rows] + done] & _LANE_MASK[np.minimum(left[rows] - done, 8)]
        h[rows] = mix(h[rows] ^ lane) + lane * begin
        done += 8
        rows = rows[left[rows] > done]
    if short is not None:
        out[short] = h
        for i, a, b in zip(long.tolist(), start[long].tolist(), end[long].tolist()):
            out[i] = int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8, salt=bytes([second])).digest(), "little")
    return mix(out)


def word_hashes(words: Words, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; `second` gives an independent one."""
    return span_hashes(words.data, words.start, words.end, second)


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(a number for each range of bytes, the distinct ranges): equal numbers mean equal bytes, which
    are compared and not only hashed. Ranges ascend and do not overlap."""
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    if len(size) and bounds[-1] == end[-1] - start[0]:
        body = data[start[0] : end[-1]]
    else:
        change = np.zeros(len(data) + 1, np.int8)
        change[start] += 1
        change[end] -= 1
        body = data[np.cumsum(change[:-1], dtype=np.int8).view(bool)]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(body))])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def dense(*columns: np.ndarray) -> np.ndarray:
    """A number for each row, equal for equal rows alone, of columns below 2**32."""
    out = columns[0].astype(U64)
    for c in columns[1:]:
        out = np.unique(out << U64(32) | c.astype(U64), return_inverse=True)[1].astype(U64)
    return out.astype(np.int64)


def window_codes(codes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, number) of every run of `width` words within one text; equal
    numbers mean equal runs, by the numbers of their words."""
    at = window_starts(first, width)
    if not len(at):
        return at, np.zeros(0, np.int64)
    out, have = codes, 1
    while have < width:
        step = min(have, width - have)
        out = dense(out[: len(out) - step], out[step:])
        have += step
    return at, out[at]


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every run of `width` words within one text."""
    at = window_starts(first, width)
    if not len(at):
        return at, np.zeros(0, U64)
    prefix = prefix_hash(hashes, 0xE7037ED1A0B428DB)
    return at, mix(range_hash(prefix, at, at + width))


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    return np.arange(total) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in every run of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        m = len(best) - step
        later = best[step:] < best[:m]
        best, at = np.where(later, best[step:], best[:m]), np.where(later, at[step:], at[:m])
        size += step
    return at
