"""Substring deduplication by looking up the hash of each window, in place of a relative Lempel-Ziv parse.

The reference is all documents; its blocks are the runs of words that share an anchor's hash
bucket (see `overlap`), so every phrase of WIDTH words is indexed in exactly one block and a
document is parsed against just the blocks that can hold its phrases. A block's index maps each
phrase to its first occurrence, by id and place. A factor begins at a phrase with an earlier first
occurrence and goes on while those of the next phrases are at the next places of that source; no
match is extended or chosen by length. Factors are cut at the borders of runs and where the source changes;
there every phrase that straddles the border is looked up by itself, so that what factors cover
is exactly the words of phrases with an earlier source. Factors that meet with one source are
joined again in the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from . import overlap
from .common import id_array, ragged

WIDTH, GRAM = 13, 5
PARSED = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<word:long, n_words:long, source_id:long, source_word:long>>"


def _values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = K.split_words(data, offsets)
    return K.word_hashes(words), words.first


def _pack(chunk: overlap.Chunk, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each phrase of the runs."""
    count = chunk.count[runs]
    at = ragged(chunk.start[runs], count)
    prefix = K.prefix_hash(chunk.values, 0xE7037ED1A0B428DB)
    return K.mix(K.range_hash(prefix, at, at + chunk.scheme.width)), count


def _match(runs: overlap.Runs) -> tuple[np.ndarray, ...]:
    """Look the phrases of a block's runs up in its index, and join hits that go on in one source."""
    n = len(runs.payload)
    run = np.repeat(np.arange(len(runs.count)), runs.count)
    place = ragged(np.zeros(len(runs.count), np.int64), runs.count)
    doc, at = runs.ids[run], runs.at[run] + place
    lead, number = overlap.smallest(runs.payload, doc, at)  # the index: phrase to first occurrence
    if (runs.anchor[run] != runs.anchor[run[lead]][number]).any():  # equal phrases have equal anchors
        anchor, phrase = (np.unique(x, return_inverse=True)[1] for x in (runs.anchor[run], runs.payload))
        lead, number = overlap.smallest(K.dense(anchor, phrase), doc, at)
    source, source_at = doc[lead][number], at[lead][number]
    hit = np.flatnonzero(source < doc)
    if not n or not len(hit):
        return (np.zeros(0, np.int64),) * 5
    run, place, source, source_at = run[hit], place[hit], source[hit], source_at[hit]
    new = np.ones(len(hit), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1]) | (source_at[1:] != source_at[:-1] + 1)
    begin = np.flatnonzero(new)
    return run[begin], place[begin], np.diff(np.append(begin, len(hit))), source[begin], source_at[begin]


SCHEME = overlap.Scheme(WIDTH, GRAM, True, False, _values, _pack, _match)


def factors(start: np.ndarray, windows: np.ndarray, source: np.ndarray, source_at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join stretches that continue each other in the document and in their source."""
    order = np.argsort(start, kind="stable")
    start, windows, source, source_at, doc = start[order], windows[order], source[order], source_at[order], doc[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != (start + windows)[:-1]) | (source[1:] != source[:-1]) | (source_at[1:] != (source_at + windows)[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    sums = np.add.reduceat(windows, at) if len(at) else windows
    return start[at], sums + WIDTH - 1, source[at], source_at[at], doc[at]


def _finish(chunk: overlap.Chunk, stretches: tuple[np.ndarray, ...]) -> pa.Table:
    start, windows, source, source_at = stretches
    n = len(chunk.doc_ids)
    first = chunk.first
    begin, length, source, source_at, doc = factors(start, windows, source, source_at, np.searchsorted(first, start, side="right") - 1)
    change = np.zeros(first[-1] + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    words = K.split_words(chunk.data, chunk.offsets)
    counts = np.diff(first)
    left = np.diff(np.concatenate([[0], np.cumsum(kept)])[first])
    text = joined(chunk.data, words.start[kept], words.end[kept], left)
    parsed = pa.StructArray.from_arrays([pa.array(begin - first[doc]), pa.array(length), id_array(source), pa.array(source_at)], names=["word", "n_words", "source_id", "source_word"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), parsed)
    return pa.table({"doc_id": id_array(chunk.doc_ids), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(counts - left, pa.int64()), "kept_text": text, "factors": lists})


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of counts[i] words each, joined by one space."""
    size = end - start + 1
    buffer = np.full(int(size.sum()), 32, np.uint8)
    stop = np.cumsum(size)
    inside = np.ones(len(buffer), dtype=bool)
    inside[stop - 1] = False
    buffer[inside] = data[ragged(start, end - start)]
    ends = np.concatenate([[0], stop])[np.cumsum(counts)]
    keep = np.ones(len(buffer), dtype=bool)
    last = ends[counts > 0] - 1  # the space after a text's last word
    keep[last] = False
    offsets = np.concatenate([[0], ends]) - np.concatenate([[0], np.cumsum(counts > 0)])
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(buffer[keep].tobytes())).cast(pa.string())


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: overlap.Sizes | None = None) -> DataFrame:
    """One row of PARSED for each document.

    Removed is each word within a phrase of WIDTH words that also starts in a document with a smaller
    id. kept_text joins the other words by one space; it is empty for a null text. factors are the
    long factors of the parse, with the first document and word that each was found at.
    """
    return overlap.find(docs, SCHEME, "<u8", _finish, PARSED, id_col, text_col, sizes)
