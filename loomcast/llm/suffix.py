"""Substring deduplication over bytes with a suffix array, built block by block.

Windows of WIDTH bytes are grouped to runs and dealt to blocks (see `overlap`). Runs whose anchor
has a single text are settled by their hashes; the text of the others goes to the blocks. In a
block, copies of one run collapse to that of the smallest id, and the windows are sorted as
suffixes:

* the places of a block's text whose number modulo 3 is in a difference cover are ranked first;
  for any two places some distance of at most two leads to a ranked place from both;
* the suffixes are sorted one bucket of leading bytes at a time. Those that tie in eight bytes
  are compared by the ranks at the distance that serves both their residues: each residue class
  is sorted by its own ranks, and the classes are merged by counting, for each suffix, the
  smaller ones of every other class.

Neighbours in the order with a common prefix of WIDTH bytes hold the same window; the smallest id
of such a group is the source of all others. The memory of a block is bounded by its text, and
that of sorting by the largest bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import overlap
from .common import id_array, ragged

WIDTH, GRAM = 50, 22
STRIPPED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long, end:long>>"

#: A difference cover modulo 3.
COVER, MODULUS = (0, 1), 3
#: Suffixes sorted at once, but for more that share eight bytes.
BUCKET = 1 << 20

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
#: Least distance at which places of two residues both meet the cover.
DISTANCE = np.array([[next(d for d in range(MODULUS) if _IN_COVER[(a + d) % MODULUS] and _IN_COVER[(b + d) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)])


def _values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K._BYTE[data], offsets


def _pack(chunk: overlap.Chunk, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each run."""
    size = chunk.count[runs] + WIDTH - 1
    return chunk.data[ragged(chunk.start[runs], size)], size


def eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number that sorts alike; text goes on with zeros."""
    out = np.zeros(len(text), K.U64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    for i in range(8):
        out |= padded[i : i + len(text)].astype(K.U64) << K.U64(56 - 8 * i)
    return out


def cover_ranks(leading: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """For each distance d, the rank of the next WIDTH - d bytes at the places of the cover.

    Together with the d bytes before them these are WIDTH bytes, so all comparisons agree.
    """
    padded = np.concatenate([leading, np.zeros(WIDTH + 8, K.U64)])
    by_first = np.argsort(leading[places], kind="stable")
    parts = [places[by_first[lo:hi]] for lo, hi in buckets(leading[places][by_first], BUCKET)]
    ordered = np.concatenate([part[np.lexsort([padded[part + s] for s in range(0, WIDTH, 8)][::-1])] for part in parts]) if parts else places
    out = []
    for d in range(MODULUS):
        new = np.zeros(len(ordered), dtype=bool)
        for s in (*range(0, WIDTH - d - 7, 8), WIDTH - d - 8):
            new[1:] |= padded[ordered[1:] + s] != padded[ordered[:-1] + s]
        ranks = np.zeros(len(leading) + MODULUS, np.int32)
        ranks[ordered] = np.cumsum(new)
        out.append(ranks)
    return out


def buckets(sorted_keys: np.ndarray, size: int):
    """Ranges of at least `size` rows that do not part equal keys."""
    at, n = 0, len(sorted_keys)
    while at < n:
        to = min(n, at + size)
        if to < n:
            to = int(np.searchsorted(sorted_keys, sorted_keys[to - 1], side="right"))
        yield at, to
        at = to


def suffix_order(text: np.ndarray, suffixes: np.ndarray, leading: np.ndarray | None = None) -> np.ndarray:
    """`suffixes` in the order of their first WIDTH bytes."""
    leading = eight(text) if leading is None else leading
    need = np.zeros(len(text) + MODULUS, dtype=bool)
    for d in range(MODULUS):
        need[suffixes + d] = True
    places = np.flatnonzero(need[: len(text)])
    ranks = cover_ranks(leading, places[_IN_COVER[places % MODULUS]])
    by_first = np.argsort(leading[suffixes], kind="stable")
    out = np.empty_like(suffixes)
    for lo, hi in buckets(leading[suffixes][by_first], BUCKET):
        part = suffixes[by_first[lo:hi]]
        first = leading[part]
        new = np.ones(len(part), dtype=bool)
        new[1:] = first[1:] != first[:-1]
        tie = (np.cumsum(new) - 1).astype(K.U64) << K.U64(32)
        residue = part % MODULUS
        place = np.zeros(len(part), np.int64)
        members = [np.flatnonzero(residue == a) for a in range(MODULUS)]
        for a, own in enumerate(members):
            for b, other in enumerate(members):
                if len(own) and len(other):
                    d = DISTANCE[a, b]
                    mine = tie[own] | ranks[d][part[own] + d].astype(K.U64)
                    if a == b:
                        count = np.empty(len(own), np.int64)
                        count[np.argsort(mine, kind="stable")] = np.arange(len(own))
                    else:
                        theirs = np.sort(tie[other] | ranks[d][part[other] + d].astype(K.U64))
                        count = np.searchsorted(theirs, mine, side="left" if a < b else "right")
                    place[own] += count
        out[lo + place] = part
    return out


def same_windows(leading: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each suffix but the first shares WIDTH bytes with the one before it in the order."""
    same = np.ones(max(0, len(ordered) - 1), dtype=bool)
    for s in (*range(0, WIDTH - 8, 8), WIDTH - 8):
        same &= leading[ordered[1:] + s] == leading[ordered[:-1] + s]
    return same


def _match(runs: overlap.Runs) -> tuple[np.ndarray, ...]:
    """Windows of the block's runs that an earlier document has."""
    n = len(runs.count)
    ends = np.cumsum(runs.sizes)
    begin = ends - runs.sizes
    # copies of a run: the smallest id leads, what all bytes confirm
    lead, number = overlap.smallest(runs.content, runs.ids, runs.at)
    of = lead[number]
    equal = runs.sizes == runs.sizes[of]
    check = np.flatnonzero(equal & (of != np.arange(n)))
    differs = runs.payload[ragged(begin[check], runs.sizes[check])] != runs.payload[ragged(begin[of[check]], runs.sizes[check])]
    equal[np.repeat(check, runs.sizes[check])[differs]] = False
    of = np.where(equal, of, np.arange(n))
    copies = np.flatnonzero(runs.ids > runs.ids[of])
    found = [(copies, np.zeros(len(copies), np.int64), runs.count[copies], runs.ids[of[copies]], runs.at[of[copies]])]
    # texts whose anchor has another text
    texts = np.flatnonzero(of == np.arange(n))
    _, which, many = np.unique(runs.anchor[texts], return_inverse=True, return_counts=True)
    texts = texts[many[which] > 1]
    if len(texts):
        text = runs.payload[ragged(begin[texts], runs.sizes[texts])]
        at = np.cumsum(runs.sizes[texts]) - runs.sizes[texts]
        suffixes, run, place = ragged(at, runs.count[texts]), np.repeat(texts, runs.count[texts]), ragged(np.zeros(len(texts), np.int64), runs.count[texts])
        leading = eight(text)
        ordered = suffix_order(text, suffixes, leading)
        row = np.empty(len(text), np.int64)
        row[suffixes] = np.arange(len(suffixes))
        rows = row[ordered]
        group = np.cumsum(np.concatenate([[True], ~same_windows(leading, ordered)])) - 1
        first, number = overlap.smallest(group, runs.ids[run[rows]], runs.at[run[rows]] + place[rows])
        source = rows[first][number]
        hit = runs.ids[run[rows]] > runs.ids[run[source]]
        back = np.full(len(suffixes), -1)
        back[rows[hit]] = source[hit]
        got = np.flatnonzero(back >= 0)
        # copies with a larger id are marked whole; those with the leader's own id have what it has
        equals = np.flatnonzero((of != np.arange(n)) & (runs.ids == runs.ids[of]))
        left = np.searchsorted(run[got], of[equals], "left")
        hits = np.searchsorted(run[got], of[equals], "right") - left
        target = np.concatenate([run[got], np.repeat(equals, hits)])
        got = np.concatenate([got, got[ragged(left, hits)]])
        found.append((target, place[got], np.ones(len(got), np.int64), runs.ids[run[back[got]]], runs.at[run[back[got]]] + place[back[got]]))
    return tuple(np.concatenate(x) for x in zip(*found))


SCHEME = overlap.Scheme(WIDTH, GRAM, False, True, _values, _pack, _match)


def _finish(chunk: overlap.Chunk, stretches: tuple[np.ndarray, ...]) -> pa.Table:
    begin, end = overlap.merge(stretches[0], stretches[1] + WIDTH - 1)
    n, offsets = len(chunk.doc_ids), chunk.offsets
    # two documents' ranges that touch are two ranges
    cut = np.searchsorted(offsets, begin, side="right") - 1
    over = end > offsets[cut + 1]
    while over.any():
        more = np.flatnonzero(over)
        begin, end = np.concatenate([begin, offsets[cut[more] + 1]]), np.concatenate([np.where(over, offsets[cut + 1], end), end[more]])
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        cut = np.searchsorted(offsets, begin, side="right") - 1
        over = end > offsets[cut + 1]
    change = np.zeros(len(chunk.data) + 1, np.int8)
    change[begin] += 1
    change[end] -= 1
    kept = np.cumsum(change, dtype=np.int8)[:-1] == 0
    left = np.diff(np.concatenate([[0], np.cumsum(kept)])[offsets])
    sizes = np.diff(offsets)
    out = np.concatenate([[0], np.cumsum(left)])
    rest = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(out.astype(np.int64).tobytes()), pa.py_buffer(chunk.data[kept].tobytes())]).cast(pa.binary())
    spans = pa.StructArray.from_arrays([pa.array(begin - offsets[cut]), pa.array(end - offsets[cut])], names=["start", "end"])
    first = np.searchsorted(cut, np.arange(n + 1))
    return pa.table({"doc_id": id_array(chunk.doc_ids), "n_bytes": pa.array(sizes), "n_removed": pa.array(sizes - left), "n_spans": pa.array(np.diff(first), pa.int64()), "kept": rest, "spans": pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans)})


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: overlap.Sizes | None = None) -> DataFrame:
    """One row of STRIPPED for each document.

    Removed is each byte within WIDTH bytes that also start in a document with a smaller id. `kept` is
    the remaining bytes, which need not be UTF-8; it is empty for a null text. `spans` are the maximal
    removed ranges of bytes.
    """
    return overlap.find(docs, SCHEME, "u1", _finish, STRIPPED, id_col, text_col, sizes)
