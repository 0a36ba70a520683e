"""Streams: windows, sessions and state machines over event time, and their batch equivalents.

Policy: event time with a watermark; rows later than it are left out of windows. A state machine
takes the rows of a key in the order of their time within each micro-batch, and its state is
dropped a while after its key was last seen.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tables import new_path

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def read_files(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A stream of the Parquet files of a folder whose name is `name`."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it gave, as a table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, f"stream-{name}")
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def tumbling(df: DataFrame, time: str, keys: Sequence[str], width: str, late: str, *aggregates) -> DataFrame:
    """(window_start, keys, aggregates) of closed windows."""
    stamped = df.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    out = stamped.groupBy(F.window("__time", width).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, *[c for c in out.columns if c not in ("w", *keys)])


def sessions(df: DataFrame, time: str, key: str, gap: str, late: str, *aggregates) -> DataFrame:
    """(session_start, session_end, key, aggregates) of closed sessions."""
    stamped = df.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    out = stamped.groupBy(F.session_window("__time", gap).alias("w"), key).agg(*aggregates)
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), key, *[c for c in out.columns if c not in ("w", key)])


def first_of(df: DataFrame, time: str, keys: Sequence[str], late: str) -> DataFrame:
    """One row of each key within the watermark."""
    return df.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late).dropDuplicatesWithinWatermark(list(keys)).drop("__time")


# --------------------------------------------------------------------------- state machines


def _rows(machine: Any, rows: Sequence[dict], keep: Sequence[str]) -> list[dict]:
    out = []
    for row in rows:
        said = machine.step(row)
        if said is not None:
            out.append({k: row[k] for k in keep} | said)
    return out


def replay(df: DataFrame, key: str, order: Sequence[str], make: Callable[[], Any], schema: str, keep: Sequence[str]) -> DataFrame:
    """Run a machine of its own over the rows of each key, in order.

    Keys are partitioned and sorted, and the rows stream through the one machine of the key at hand,
    so a long key takes no memory.
    """
    kind = T._parse_datatype_string(schema)
    sorted_ = df.repartition(F.col(key)).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        now, machine = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != now:
                    now, machine = row[key], make()
                out += _rows(machine, [row], keep)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return sorted_.mapInArrow(run, kind)


def stateful(df: DataFrame, key: str, order: Sequence[str], make: Callable[[], Any], schema: str, keep: Sequence[str], time: str | None = None, late: str = "10 minutes", idle_s: int = 300) -> DataFrame:
    """The same machine over a stream. With an event time, the state of a key goes `idle_s` after its
    last row, once the watermark has passed; without, it stays."""
    names = T._parse_datatype_string(schema).names
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine = pickle.loads(state.get[0]) if state.exists else make()
        rows = pd.concat(parts, ignore_index=True).sort_values(list(order), kind="stable")
        if time:
            last = int(pd.to_datetime(rows[time]).max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1000 * idle_s)
        rows = rows.astype(object).where(rows.notna(), None)
        out = _rows(machine, rows.to_dict("records"), keep)
        state.update((pickle.dumps(machine),))
        yield pd.DataFrame(out, columns=names)

    stamped = df.withWatermark(time, late) if time else df
    return stamped.groupBy(key).applyInPandasWithState(run, schema, "machine binary", "append", timeout)


def rotate(df: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """`df` with segment, the tumbling file of its session that a row falls in, from the key's first row."""
    start = F.min(time).over(Window.partitionBy(key))
    return df.withColumn("segment", F.floor((F.col(time) - start) / seconds).cast("long"))


def recordings(frames: DataFrame, key: str, time: str, events: str, preroll_s: float = 5.0) -> DataFrame:
    """(key, file, t0, t1) of the files that a recorder makes of events: from preroll_s before a
    start_recording to the next stop_recording; t1 is null while a file is open. A stop and a start
    in one row end one file and begin the next."""
    each = frames.select(key, F.col(time).alias("__t"), F.posexplode(events).alias("__i", "__e")).where(F.col("__e").isin("start_recording", "stop_recording"))
    w = Window.partitionBy(key).orderBy("__t", "__i")
    files = each.withColumns({"file": F.sum((F.col("__e") == "start_recording").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "t1": F.when(F.lead("__e").over(w) == "stop_recording", F.lead("__t").over(w))})
    return files.where("__e = 'start_recording'").select(key, "file", (F.col("__t") - preroll_s).alias("t0"), "t1")


def encounter_files(encounters: DataFrame, files: DataFrame, key: str, width: float = 300.0) -> DataFrame:
    """Encounters (key, id, t_start, t_end) with the files that hold them and where in those they begin:
    files is an array of (file, offset_s), empty where nothing was recorded."""
    from ..operators.joins import interval_overlap, overlap_offset

    told = encounters.select(key, "id", "t_start", "t_end")
    both = interval_overlap(told, files.select(key, "file", "t0", "t1"), ("t_start", "t_end"), ("t0", "t1"), width, [key])
    one = F.struct("file", F.round(overlap_offset(F.col("t_start"), F.col("t0")), 2).alias("offset_s"))
    held = both.groupBy(key, "id").agg(F.array_sort(F.collect_list(one)).alias("files"))
    return encounters.join(held, [key, "id"], "left").withColumn("files", F.coalesce("files", F.array().cast(held.schema["files"].dataType)))


def on_close(files: DataFrame, key: str, sinks: Sequence[Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the encounters that a batch ended, with their files, to all sinks."""
    from ..sources.writers import fan_out

    send = fan_out(sinks)
    return lambda batch, n: send(encounter_files(batch, files, key), n)
