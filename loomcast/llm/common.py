"""Plumbing shared by the corpus operators: batching, tables on shared storage, settings.

Conventions of every operator in this subpackage:

* only the id and text columns are read, by name; other columns, whatever their names, are
  not looked at;
* a null text counts as empty;
* a null id sorts after every other id, so such a row is never the earlier copy of another;
* rows that repeat an id are separate documents of equal age: neither is the earlier one;
* an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = (1 << 63) - 1
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that cut lineage: spark.checkpoint.dir. Where it is unset, a session on this
    machine alone gets a temporary one; a cluster must name a folder that all its machines share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="loomcast-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold at most `rows` documents, as whole texts are far larger than the rows that
    the default of 10000 is made for. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that later steps neither recompute it
    nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomcast/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomcast_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of materialize() that nothing will read again."""
    path = getattr(df, "_loomcast_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spark_hash(keys: np.ndarray) -> np.ndarray:
    """The hash by which Spark partitions rows on one long column: Murmur3 of 32 bits, seed 42."""
    keys = np.asarray(keys, dtype=np.int64).view(np.uint64)
    h = np.full(len(keys), 42, np.uint32)
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    for half in (keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)):
        h ^= turn(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return h.view(np.int32)


def even_keys(n: int, parts: int) -> np.ndarray:
    """n distinct longs, ascending within each residue: the i-th falls into partition i modulo `parts`
    where rows are dealt to so many by it. So a few keys to a partition stay a few."""
    rounds = -(-n // parts)
    found: list[list[np.ndarray]] = [[] for _ in range(2)]
    have, at = np.zeros(parts, np.int64), 0
    while have.min() < rounds:
        keys = np.arange(at, at + max(1024, 2 * n))
        at = int(keys[-1]) + 1
        where = np.mod(spark_hash(keys).astype(np.int64), parts)
        found[0].append(keys)
        found[1].append(where)
        have += np.bincount(where, minlength=parts)
    keys, where = (np.concatenate(x) for x in found)
    order = np.argsort(where, kind="stable")
    first = np.searchsorted(where[order], np.arange(parts))
    i = np.arange(n)
    return keys[order[first[i % parts] + i // parts]]


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """The id (long) and text (string) of each row, and any further columns asked for."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in more])


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of `df` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def ids(batch: pa.RecordBatch | pa.Table, name: str = "doc_id") -> np.ndarray:
    """Ids as int64, nulls as the last id."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def id_array(values: np.ndarray) -> pa.Array:
    values = np.asarray(values, dtype=np.int64)
    return pa.array(values, mask=values == LAST_ID)


def texts(batch: pa.RecordBatch | pa.Table) -> pa.Array:
    col = batch.column("text")
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def pieces(batch: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about `size` bytes of text; a longer text makes a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    import pyarrow.compute as pc

    length = pc.binary_length(texts(batch)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(length, dtype=np.int64)
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        to = min(max(to, at + 1), at + rows, n)
        yield batch.slice(at, to - at)
        at = to


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """Apply `make()`, called once a task, to slices of (doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for piece in pieces(batch, rows, size):
                out = each(piece)
                if out is not None:
                    yield release(out)

    return df.mapInArrow(run, schema)


def release(out):
    """`out`, once freed memory has gone back to the system: between the slices that a worker handles."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
    return out


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every (start, length), one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(np.asarray(starts, dtype=np.int64) - (np.cumsum(lengths) - lengths), lengths)


def rewrite_texts(df: DataFrame, make: Callable[[], Callable[[pa.Array], np.ndarray | pa.Array]], text_col: str = "text", size: int = BATCH_BYTES) -> DataFrame:
    """Filter rows or replace texts, with all columns of `df` kept as they are.

    `make()`, called once a task, gives a function from texts to either a boolean array, of rows
    to keep, or new texts.
    """
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            names = batch.schema.names
            at = names.index(text_col)
            for piece in pieces(pa.RecordBatch.from_arrays([batch.column(at), *batch.columns], names=["text", *map(str, range(len(names)))]), size=size):
                out = each(piece.column(0))
                if isinstance(out, np.ndarray):
                    kept = piece.filter(pa.array(out))
                    yield release(pa.RecordBatch.from_arrays(kept.columns[1:], names=names))
                else:
                    columns = piece.columns[1:]
                    columns[at] = out.cast(batch.schema.field(at).type)
                    yield release(pa.RecordBatch.from_arrays(columns, names=names))

    return df.mapInArrow(run, schema)
