"""Exact detection of repeated windows across documents, in three passes over chunks of them.

A window is `width` consecutive units (words or bytes) of one document. Wanted is, for each
window, whether its sequence also starts in a document with a smaller id. To ship every window
would multiply the data, so windows are grouped by anchors: the anchor of a window is its gram
of `gram` units with the smallest hash, the leftmost of equal ones. Equal windows have equal
anchors, and neighbouring windows mostly share one; a run is a stretch of windows with one
anchor.

1. Each chunk of documents says which anchor hashes it has, deduplicated, in 4 bytes each, dealt
   to buckets by hash. A bucket answers each chunk which of them another chunk has too. A false
   match of 4 bytes only makes work, it changes no result.
   Where the caller asks for it, chunks then say which contents they have at these anchors, by
   hash. Runs of an anchor with one content everywhere are settled: the smallest id is the source
   of all others. Only runs at the other anchors go on.
2. Each chunk sends its runs at shared anchors to the blocks of their hash, one of each content:
   that of its smallest id. A block holds every run that can match another, indexes them by the
   method of the caller and answers which windows of a run have an earlier source.
3. Each chunk marks the windows of its documents: of a run in its chunk's smallest document, what
   the block answered; of later copies of the run, all.

A run that a third of all documents hold is shipped once a chunk. Chunks are groups of whole
documents dealt by hash, a few MB each, whose number grows with the data; the documents are
shuffled to them once and that exchange is read three times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import documents, even_keys, ids, partitions, ragged, release, texts

#: Bytes of text that a chunk, a shuffle partition and (at least) a bucket of hashes stand for, where a
#: caller names no Sizes.
CHUNK_BYTES, PARTITION_BYTES, BUCKET_BYTES = 4 << 20, 24 << 20, 1 << 20
#: Bytes of text whose windows are hashed at once.
SLICE_BYTES = 500_000
LOW = K.U64(0xFFFFFFFF)


@dataclass(frozen=True)
class Sizes:
    """Bytes of text from which the numbers of chunks, shuffle partitions and buckets are chosen.

    A chunk sends a row to each bucket it has a hash in, and a run that most documents hold once to one
    bucket, so a bucket can hold as many copies of a run as there are chunks. Larger chunks make both
    fewer, for more memory of a task: about forty times the bytes of a chunk.
    """

    chunk: int = CHUNK_BYTES
    partition: int = PARTITION_BYTES
    bucket: int = BUCKET_BYTES


@dataclass(frozen=True)
class Scheme:
    """What a window is and how blocks match runs.

    values(data, offsets) gives the hashed units of texts and the first unit of each; `keep` says
    whether a chunk keeps them. `settle` asks for a round before the second pass in which runs whose
    anchor has one content everywhere are answered by hashes alone. `pack` gives the bytes that describe the windows of runs to a block, and
    `match` finds in a block, for each run, pieces (run, first window, windows, source id, source unit)
    with an earlier source.
    """

    width: int
    gram: int
    keep: bool
    settle: bool
    values: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    pack: Callable[[Chunk, np.ndarray], tuple[np.ndarray, np.ndarray]]
    match: Callable[[Runs], tuple[np.ndarray, ...]]


@dataclass
class Chunk:
    """Documents of one chunk: bytes, units and runs."""

    scheme: Scheme
    doc_ids: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    values: np.ndarray
    first: np.ndarray
    start: np.ndarray  # first unit of each run's first window
    count: np.ndarray  # windows of each run
    anchor: np.ndarray  # hash of each run's anchor
    content: np.ndarray  # hash of each run's units and of where its anchor is
    doc: np.ndarray  # text of each run

    @property
    def ids(self) -> np.ndarray:
        return self.doc_ids[self.doc]


@dataclass
class Runs:
    """Runs of many chunks in one block."""

    chunk: np.ndarray
    content: np.ndarray
    anchor: np.ndarray
    ids: np.ndarray
    at: np.ndarray
    count: np.ndarray
    payload: np.ndarray
    sizes: np.ndarray


def read_chunk(part: pa.Table, scheme: Scheme) -> Chunk:
    data, offsets = K.text_buffer(texts(part))
    found, kept, firsts = [], [], [np.zeros(1, np.int64)]
    n = len(offsets) - 1
    at = begin = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), n)
        values, first = scheme.values(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        start, *rest = _runs(values, first, scheme)
        found.append([start + begin, *rest])
        firsts.append(first[1:] + begin)
        begin += int(first[-1])
        if scheme.keep:
            kept.append(values)
        at = to
    first = np.concatenate(firsts)
    start, count, anchor, content = (np.concatenate(x) for x in zip(_NO_RUNS, *found))
    doc = np.searchsorted(first, start, side="right") - 1
    return Chunk(scheme, ids(part), data, offsets, np.concatenate([np.zeros(0, K.U64), *kept]), first, start, count, anchor, content, doc)


_NO_RUNS = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, K.U64), np.zeros(0, K.U64)]
#: Low bits of a gram's hash that give way to its place while the smallest is sought.
PLACE_BITS = 20


def _runs(values: np.ndarray, first: np.ndarray, scheme: Scheme) -> list[np.ndarray]:
    n, width, gram = len(values), scheme.width, scheme.gram
    if n < width:
        return _NO_RUNS
    sums, down = K.prefix_hash(values, 0x8EBC6AF09C88C6E3)
    grams = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    grams ^= grams >> K.U64(32)
    grams *= K.U64(0xD6E8FEB86659FD93)
    grams ^= grams >> K.U64(29)
    lead = leftmost_smallest(grams, width - gram + 1)
    new = np.ones(len(lead), dtype=bool)
    np.not_equal(lead[1:], lead[:-1], out=new[1:])
    for cut in (first[:-1], first[1:] - width + 1):  # where a text's windows begin, and where they end
        new[cut[(cut >= 0) & (cut < len(new))]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(new)))
    inside = start + width <= first[np.searchsorted(first, start, side="right")]
    start, count = start[inside], count[inside]
    lead = lead[start]
    end = start + count + width - 1
    body = (sums[end] - sums[start]) * down[start]
    content = K.mix(body + K.mix(count.astype(K.U64) * K.U64(1 << 32) + (lead - start).astype(K.U64) + K.U64(1)))
    return [start, count, K.mix(grams[lead]), content]


def leftmost_smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest gram, the leftmost of equals, in every run of `width` grams.

    The place takes the low bits of the hash, so that smallest values alone are compared. Equal grams
    still compare by place; which of two grams that agree in the high bits wins is settled by place
    too, alike wherever the same window stands.
    """
    if len(grams) >> PLACE_BITS:
        return K.sliding_argmin(grams >> K.U64(PLACE_BITS), width)
    low = K.U64((1 << PLACE_BITS) - 1)
    best, size = (grams & ~low) | np.arange(len(grams), dtype=K.U64), 1
    while size < width:
        step = min(size, width - size)
        best = np.minimum(best[:-step], best[step:])
        size += step
    return (best & low).astype(np.int64)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> K.U64(32)) % K.U64(n)).astype(np.int64)


def bucket_keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket and the 4 bytes that a bucket sees of a hash, in one number."""
    return (bucket_of(hashes, n).astype(K.U64) << K.U64(32)) | (hashes & LOW)


def by_group(group: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each group, groups ascending and rows in order."""
    order = np.argsort(group, kind="stable")
    which, at = np.unique(group[order], return_index=True)
    ends = np.append(at[1:], len(order))
    for g, a, b in zip(which.tolist(), at.tolist(), ends.tolist()):
        rows = order[a:b]
        yield g, [c[rows] for c in columns]


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unblob(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of blobs, and the row of each."""
    parts = [np.frombuffer(x or b"", dtype=dtype) for x in column.to_pylist()]
    if not parts:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _said(rows: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array(rows[f.name], f.type) for f in schema}, schema=schema)


def _rows(schema: pa.Schema) -> dict[str, list]:
    return {name: [] for name in schema.names}


HAVE = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("low", pa.binary())])
SHARED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("low", pa.binary())])
CONTENTS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("content", "low", "ids", "index")]])
SETTLED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("low", pa.binary()), ("copies", pa.binary())])
SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("content", "anchor", "ids", "at", "count", "payload", "sizes")]])
ANSWER = pa.schema([("chunk", pa.int64()), *[(c, pa.binary()) for c in ("content", "first", "windows", "source", "source_at")]])
_DDL = {pa.int64(): "long", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_DDL[f.type]}" for f in schema)


def anchors_of(part: pa.Table, scheme: Scheme, buckets: int) -> pa.Table:
    rows = _rows(HAVE)
    chunk = read_chunk(part, scheme)
    keys = np.unique(bucket_keys(chunk.anchor, buckets))
    for b, (own,) in by_group((keys >> K.U64(32)).astype(np.int64), keys):
        rows["bucket"].append(b)
        rows["chunk"].append(part["chunk"][0].as_py())
        rows["low"].append(blob((own & LOW).astype("<u4")))
    return _said(rows, HAVE)


def shared_anchors(part: pa.Table) -> pa.Table:
    low, row = unblob(part["low"], "<u4")
    order = np.argsort(low, kind="stable")
    values = low[order]
    same = values[1:] == values[:-1]
    many = np.zeros(len(values), dtype=bool)
    many[1:] |= same
    many[:-1] |= same
    rows = _rows(SHARED)
    chunks = part["chunk"].to_pylist()
    for r, (own,) in by_group(row[order][many], values[many]):
        rows["chunk"].append(chunks[r])
        rows["bucket"].append(part["bucket"][0].as_py())
        rows["low"].append(blob(own))
    return _said(rows, SHARED)


def smallest(keys: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the smallest `order` for each distinct key, the distinct key's number of each row)."""
    by = np.lexsort((*reversed(order), keys))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[by[1:]] != keys[by[:-1]]
    number = np.empty(len(keys), np.int64)
    number[by] = np.cumsum(new) - 1
    return by[new], number


def send_runs(part: pa.Table, shared: pa.Table, scheme: Scheme, buckets: int) -> pa.Table:
    rows = _rows(SENT)
    if not part.num_rows:
        return _said(rows, SENT)
    chunk, wanted = told_of(part, shared, scheme, buckets)
    doc_ids = chunk.ids
    runs = np.flatnonzero(wanted if scheme.settle else wanted | shared_within(chunk.anchor, doc_ids))
    once, _ = smallest(chunk.content[runs], doc_ids[runs], chunk.start[runs])
    runs = np.sort(runs[once])
    payload, sizes = scheme.pack(chunk, runs)
    ends = np.cumsum(sizes)
    for b, (own,) in by_group(bucket_of(chunk.anchor[runs], buckets), np.arange(len(runs))):
        mine = runs[own]
        said = {"content": chunk.content[mine], "anchor": chunk.anchor[mine], "ids": doc_ids[mine], "at": (chunk.start[mine] - chunk.first[chunk.doc[mine]]).astype("<u4"), "count": chunk.count[mine].astype("<u2"), "payload": payload[ragged((ends - sizes)[own], sizes[own])], "sizes": sizes[own].astype("<u2")}
        rows["bucket"].append(b)
        rows["chunk"].append(part["chunk"][0].as_py())
        for name, values in said.items():
            rows[name].append(blob(values))
    return _said(rows, SENT)


def told_of(part: pa.Table, shared: pa.Table, scheme: Scheme, buckets: int) -> tuple[Chunk, np.ndarray]:
    """A chunk and its runs at anchors that `shared` (SHARED rows) or two of its documents share."""
    chunk = read_chunk(part, scheme)
    low, row = unblob(shared["low"], "<u4")
    there = np.sort((np.asarray(shared["bucket"].to_pylist(), dtype=K.U64)[row] << K.U64(32)) | low.astype(K.U64)) if len(low) else np.zeros(0, K.U64)
    return chunk, np.isin(bucket_keys(chunk.anchor, buckets), there)


def send_contents(part: pa.Table, shared: pa.Table, scheme: Scheme, buckets: int) -> pa.Table:
    rows = _rows(CONTENTS)
    if not part.num_rows:
        return _said(rows, CONTENTS)
    chunk, wanted = told_of(part, shared, scheme, buckets)
    doc_ids = chunk.ids
    runs = np.flatnonzero(wanted | shared_within(chunk.anchor, doc_ids))
    once, _ = smallest(chunk.content[runs], doc_ids[runs])
    runs = runs[once]
    for b, (content, anchor, own) in by_group(bucket_of(chunk.anchor[runs], buckets), chunk.content[runs], chunk.anchor[runs], doc_ids[runs]):
        table, index = np.unique(own, return_inverse=True)
        for name, value in zip(CONTENTS.names, (b, part["chunk"][0].as_py(), blob(content), blob((anchor & LOW).astype("<u4")), blob(table), blob(index.astype("<u4" if len(table) >> 16 else "<u2")))):
            rows[name].append(value)
    return _said(rows, CONTENTS)


def shared_within(anchor: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
    """Which runs have an anchor that another document of the chunk has."""
    lead, number = smallest(anchor, doc_ids)
    return np.bincount(number, doc_ids != doc_ids[lead][number])[number] > 0 if len(anchor) else np.zeros(0, bool)


def settle_block(part: pa.Table) -> pa.Table:
    """Of anchors with one content: the copies. Of the others: that their windows must be compared."""
    content, row = unblob(part["content"], "<u8")
    low, _ = unblob(part["low"], "<u4")
    own = []
    for table, index in zip(part["ids"].to_pylist(), part["index"].to_pylist()):
        table = np.frombuffer(table, "<i8")
        own.append(table[np.frombuffer(index, "<u4" if len(table) >> 16 else "<u2")])
    own = np.concatenate(own) if own else np.zeros(0, np.int64)
    first, which = smallest(low, content)
    mixed = np.bincount(which, content != content[first][which])[which] > 0 if len(low) else np.zeros(0, bool)
    # copies agree in bucket, anchor and content; anchors that are not mixed have one content
    lead, number = smallest(which, own)
    copy = ~mixed & (own > own[lead][number])
    rows, chunks = _rows(SETTLED), part["chunk"].to_pylist()
    some = copy | mixed
    for r, (is_mixed, anchors, found) in by_group(row[some], mixed[some], low[some], content[some]):
        for name, value in zip(SETTLED.names, (chunks[r], part["bucket"][0].as_py(), blob(np.unique(anchors[is_mixed])), blob(found[~is_mixed]))):
            rows[name].append(value)
    return _said(rows, SETTLED)


def match_block(part: pa.Table, scheme: Scheme, payload: str) -> pa.Table:
    content, row = unblob(part["content"], "<u8")
    runs = Runs(row, content, unblob(part["anchor"], "<u8")[0], unblob(part["ids"], "<i8")[0], unblob(part["at"], "<u4")[0].astype(np.int64), unblob(part["count"], "<u2")[0].astype(np.int64), unblob(part["payload"], payload)[0], unblob(part["sizes"], "<u2")[0].astype(np.int64))
    run, first, windows, source, source_at = scheme.match(runs)
    rows = _rows(ANSWER)
    chunks = part["chunk"].to_pylist()
    for r, found in by_group(row[run], content[run], first.astype("<u2"), windows.astype("<u2"), source.astype("<i8"), source_at.astype("<u4")):
        rows["chunk"].append(chunks[r])
        for name, values in zip(("content", "first", "windows", "source", "source_at"), found):
            rows[name].append(blob(values))
    return _said(rows, ANSWER)


def repeated(chunk: Chunk, answer: pa.Table) -> tuple[np.ndarray, ...]:
    """(first unit, windows, source id, source unit) of each stretch of windows with an earlier source."""
    if not len(chunk.content):
        return (np.zeros(0, np.int64),) * 4
    doc_ids, within = chunk.ids, chunk.start - chunk.first[chunk.doc]
    lead, number = smallest(chunk.content, doc_ids, chunk.start)
    later = np.flatnonzero(doc_ids > doc_ids[lead][number])
    found = [(chunk.start[later], chunk.count[later], doc_ids[lead][number[later]], within[lead][number[later]])]
    if "copies" in answer.column_names:  # contents settled as copies
        copies, _ = unblob(answer["copies"], "<u8")
        whole = np.flatnonzero((doc_ids == doc_ids[lead][number]) & np.isin(chunk.content, copies))
        found.append((chunk.start[whole], chunk.count[whole], np.full(len(whole), -1), np.zeros(len(whole), np.int64)))
    content, _ = unblob(answer["content"], "<u8")
    if len(content):
        order = np.argsort(content, kind="stable")
        first, windows, source, source_at = (unblob(answer[c], t)[0][order].astype(np.int64) for c, t in (("first", "<u2"), ("windows", "<u2"), ("source", "<i8"), ("source_at", "<u4")))
        content = content[order]
        leads = np.flatnonzero(doc_ids == doc_ids[lead][number])
        left = np.searchsorted(content, chunk.content[leads], "left")
        hits = np.searchsorted(content, chunk.content[leads], "right") - left
        run, piece = np.repeat(leads, hits), ragged(left, hits)
        found.append((chunk.start[run] + first[piece], windows[piece], source[piece], source_at[piece]))
    return tuple(np.concatenate(x) for x in zip(*found))


def find(docs: DataFrame, scheme: Scheme, payload: str, finish: Callable[[Chunk, tuple[np.ndarray, ...]], pa.Table], schema: str, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes | None = None) -> DataFrame:
    """Run the three passes; `finish` turns a chunk and its repeated stretches into rows of `schema`."""
    spark = docs.sparkSession
    sizes = sizes or Sizes(CHUNK_BYTES, PARTITION_BYTES, BUCKET_BYTES)
    own = documents(docs, id_col, text_col)
    size = own.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(partitions(spark), -(-size // sizes.partition))
    chunks = max(parts, -(-size // sizes.chunk))
    buckets = max(1, min(parts, -(-size // sizes.bucket)))
    dealt = _dealt(own, chunks, parts).repartition(parts, "chunk")

    def anchors(part: pa.Table) -> pa.Table:
        return release(keyed(anchors_of(part, scheme, buckets)))

    def runs(part: pa.Table, shared: pa.Table) -> pa.Table:
        return release(keyed(send_runs(part, numbered(shared), scheme, buckets)))

    def contents(part: pa.Table, shared: pa.Table) -> pa.Table:
        return release(keyed(send_contents(part, numbered(shared), scheme, buckets)))

    # on the way, a bucket is known by a key that Spark deals to a partition of its own
    def keyed(table: pa.Table) -> pa.Table:
        return table.set_column(0, "bucket", pa.array(_names(buckets, parts)[0][table["bucket"].to_numpy()], pa.int64()))

    def numbered(table: pa.Table) -> pa.Table:
        at = table.column_names.index("bucket")
        keys, order = _names(buckets, parts)
        return table.set_column(at, "bucket", pa.array(order[np.searchsorted(keys, table["bucket"].to_numpy(), sorter=order)], pa.int64()))

    def block(part: pa.Table) -> pa.Table:
        return release(match_block(part, scheme, payload))

    empty = finish(read_chunk(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), scheme), (np.zeros(0, np.int64),) * 4)

    def mark(part: pa.Table, answer: pa.Table) -> pa.Table:
        if not part.num_rows:
            return empty
        chunk = read_chunk(part, scheme)
        return release(finish(chunk, repeated(chunk, answer)))

    have = dealt.groupBy("chunk").applyInArrow(anchors, ddl(HAVE)).repartition(parts, "bucket")
    shared = have.groupBy("bucket").applyInArrow(shared_anchors, ddl(SHARED)).repartition(parts, "chunk")
    settled = None
    if scheme.settle:
        held = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(contents, ddl(CONTENTS)).repartition(parts, "bucket")
        settled = held.groupBy("bucket").applyInArrow(settle_block, ddl(SETTLED)).repartition(parts, "chunk")
        shared = settled
    sent = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(runs, ddl(SENT)).repartition(parts, "bucket")
    answers = sent.groupBy("bucket").applyInArrow(block, ddl(ANSWER)).repartition(parts, "chunk")
    if settled is not None:
        answers = answers.unionByName(settled, allowMissingColumns=True)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(mark, schema)


@lru_cache(4)
def _names(buckets: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(the key of each bucket, buckets by their keys), made once in each worker."""
    keys = even_keys(buckets, parts)
    return keys, np.argsort(keys)


#: Chunks up to which their keys are a constant of the plan.
LISTED = 4096


def _dealt(own: DataFrame, chunks: int, parts: int) -> DataFrame:
    """(chunk, doc_id, text): documents dealt to chunks by a hash, evenly many chunks to a partition."""
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    if chunks <= LISTED:
        return own.withColumn("chunk", F.element_at(F.lit(even_keys(chunks, parts).tolist()), number + 1).cast("long"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = even_keys(chunks, parts)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every[batch.column(0).to_numpy()], pa.int64())], names=["number", "chunk"])

    # 16 bytes a chunk: a few MB for a million
    named = own.sparkSession.range(0, chunks, 1, 1).mapInArrow(keys, "number long, chunk long")
    return own.withColumn("number", number.cast("long")).join(F.broadcast(named), "number").select("doc_id", "text", "chunk")


def merge(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges as (start, end) of its maximal ranges, ascending."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + length)[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:] - 1, len(start) - 1)]
