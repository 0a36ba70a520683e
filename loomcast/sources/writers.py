"""Sinks: tables, logs, packs and Markdown reports."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """A Parquet table in place of the one at `path`; the commit of the job makes it appear at once."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_file(spark, path: str, data: bytes | str) -> None:
    """One file in place of another, whole or not at all: it is written beside and then renamed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, beside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(beside)
    try:
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
        out.hsync()
    finally:
        out.close()
    if files.exists(at):
        files.delete(at, False)
    if not files.rename(beside, at):
        raise OSError(f"{path} could not be written")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def fan_out(sinks: Sequence[Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that gives a batch to all sinks, reading it once."""

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch)
        finally:
            batch.unpersist()

    return each


def discard(batch: DataFrame) -> None:
    """The sink of a vehicle without one."""


def send_udp(host: str = "127.0.0.1", port: int = 14600) -> Callable[[DataFrame], None]:
    """A sink that sends each row as a JSON datagram from the task that has it; what the network does not
    take at once is dropped."""

    def each(rows) -> None:
        import socket

        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            out.setblocking(False)
            for row in rows:
                try:
                    out.sendto(row.value.encode(), (host, port))
                except OSError:
                    pass

    return lambda batch: batch.select(F.to_json(F.struct("*")).alias("value")).foreachPartition(each)


def sinks(specs: Sequence[dict]) -> list[Callable[[DataFrame], None]]:
    """The sinks of settings: {kind: jsonl, path}, {kind: udp, host, port}, {kind: null}."""
    made = {"jsonl": lambda path: lambda batch: append_log(batch, path), "udp": send_udp, "null": lambda: discard}
    out = []
    for spec in specs:
        kind = spec.get("kind") or "null"
        if kind not in made:
            raise ValueError(f"no sink {kind}; there are {', '.join(made)}")
        out.append(made[kind](**{k: v for k, v in spec.items() if k != "kind"}))
    return out


def deletable(packs: DataFrame, loose: DataFrame) -> DataFrame:
    """The keys of loose files (key, content) whose bytes the latest part of a pack has alike and whole."""
    latest = packs.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(F.col("part").desc()))).where("__n = 1")
    held = latest.where((F.crc32("content") == F.col("crc32")) & (F.length("content") == F.col("length"))).select("key", F.col("content").alias("__held"))
    return loose.join(held, "key").where(F.col("content") == F.col("__held")).select("key")


def delete_packed(packs: DataFrame, loose: DataFrame, folder: str) -> int:
    """Delete the loose files below `folder` that the packs hold byte for byte, and folders left empty;
    returns how many files went. The keys come to the driver a partition at a time."""
    spark = packs.sparkSession
    keys = deletable(packs, loose).toLocalIterator()
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    for row in keys:
        at = hadoop.Path(root, row.key)
        if files.delete(at, False):
            n += 1
            at = at.getParent()
            while not at.equals(root) and len(files.listStatus(at)) == 0:
                files.delete(at, False)
                at = at.getParent()
    return n


def extract(archive: str, folder: str) -> list[str]:
    """Unpack a tar or zip file; a member that would land outside the folder, and a link, is an error
    before anything is written. Returns the members' names."""
    import tarfile
    import zipfile
    from pathlib import Path

    root = Path(folder).resolve()

    def check(name: str, link: bool = False) -> str:
        if link:
            raise OSError(f"a link in an archive: {name}")
        if not (root / name).resolve().is_relative_to(root):
            raise OSError(f"a path out of the archive: {name}")
        return name

    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            names = [check(i.filename, (i.external_attr >> 16) & 0o170000 == 0o120000) for i in z.infolist()]
            root.mkdir(parents=True, exist_ok=True)
            z.extractall(root)
    else:
        with tarfile.open(archive) as t:
            names = [check(m.name, m.issym() or m.islnk()) for m in t.getmembers()]
            root.mkdir(parents=True, exist_ok=True)
            t.extractall(root, filter="data")
    return names


def pack(files: DataFrame, packs: DataFrame | None) -> DataFrame:
    """The part to append to a pack: files (key, content, mtime) that it does not hold alike, numbered
    after its last part, with an offset in the order of keys."""
    rows = files.select("key", "content", F.length("content").cast("long").alias("length"), "mtime", F.crc32("content").alias("crc32"))
    part = 0
    if packs is not None:
        part = (packs.agg(F.max("part")).first()[0] or 0) + 1
        rows = rows.join(packs.select("key", "length", "crc32").distinct(), ["key", "length", "crc32"], "left_anti")
    before = Window.partitionBy(F.pmod(F.xxhash64("key"), F.lit(64))).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"part": F.lit(part), "shard": F.pmod(F.xxhash64("key"), F.lit(64)).cast("int"), "offset": F.coalesce(F.sum("length").over(before), F.lit(0))})


def verify(packs: DataFrame) -> DataFrame:
    """The keys whose content is not what was packed."""
    return packs.where((F.crc32("content") != F.col("crc32")) | (F.length("content") != F.col("length"))).select("key", "part")


def number(value, digits: int = 3) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "–"
    return f"{value:.{digits}g}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame, titles: Sequence[str] | None = None, order: Sequence[str] = (), most: int = 1000) -> str:
    """A table of an aggregate; the rows of a report are few, and more than `most` are an error."""
    rows = (df.orderBy(*order) if order else df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = list(titles or df.columns)
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join([*lines, *["| " + " | ".join(number(v) for v in r) + " |" for r in rows]]) + "\n"


def curation_log(config: dict, thresholds: dict, steps: Sequence[dict]) -> str:
    return json.dumps({"config": config, "thresholds": thresholds, "steps": list(steps)}, sort_keys=True, indent=1)
