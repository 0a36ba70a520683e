"""Queries that run as streams over a folder's events, and state machines in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import machines, run
from .base import TELEMETRY, Query, telemetry


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.read_files(spark, sf_dir, "events.parquet", run.EVENTS)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run.tumbling(_events(spark, sf_dir), "ts", ["event_type"], "6 hours", "10 minutes", F.count("*").alias("n"), F.sum("value").alias("value"))
    return run.drain(out, "tumbling").withColumn("value", F.round("value", 2))


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run.sessions(_events(spark, sf_dir), "ts", "user_id", "2 hours", "10 minutes", F.count("*").alias("n"), F.max("value").alias("highest"))
    return run.drain(out, "session")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.drain(run.first_of(_events(spark, sf_dir), "ts", ["event_id"], "10 minutes"), "dedup").select("event_id", "user_id", "event_type")


FRAMES = ["vehicle", "event_id", "t"]
SAID = "vehicle long, event_id long, t double, state string, events array<string>, recording boolean, reason string"


def _frames(rows: DataFrame) -> DataFrame:
    """Rows for the phase machine, from events as telemetry."""
    k = F.col("k")
    return rows.select("vehicle", "event_id", "t", (F.col("depth") > 30).alias("hit"), (k % 4 > 0).alias("confirmed"), (k % 10 > 0).alias("active"), (k % 5).alias("misses"), (F.col("depth") < 60).alias("framed"), F.when(k > 96, "budget").alias("release"))


def state_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run.replay(_frames(telemetry(spark, sf_dir)), "vehicle", ["t", "event_id"], machines.Phases, SAID, FRAMES)
    return out.select("event_id", "state", F.array_join("events", ",").alias("events"), "recording", "reason")


def stream_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same machine over the stream of events."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("vehicle"), "event_id", ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 36e9).alias("t"), F.col("value").alias("depth"), k.alias("k"))
    out = run.stateful(_frames(rows), "vehicle", ["t", "event_id"], machines.Phases, SAID, FRAMES)
    return run.drain(out, "phases").select("event_id", "state", F.array_join("events", ",").alias("events"), "recording", "reason")


def state_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).select("vehicle", "event_id", "t", (F.col("k") * 7919).alias("hash"))
    out = run.replay(rows, "vehicle", ["t", "event_id"], lambda: machines.Gate(1.0, 3), "vehicle long, event_id long, kept boolean, why string", ["vehicle", "event_id"])
    return out.select("event_id", "kept", "why")


def state_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).select("vehicle", "event_id", "t")
    out = run.replay(rows, "vehicle", ["t", "event_id"], lambda: machines.Decimator(0.5), "vehicle long, event_id long, kept boolean", ["vehicle", "event_id"])
    return out.where("kept").select("event_id", "vehicle")


def state_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run.rotate(telemetry(spark, sf_dir), "vehicle", "t", 30.0)
    return rows.groupBy("vehicle", "segment").agg(F.count("*").alias("n"), F.round(F.max("t"), 5).alias("last"))


#: The phase machine a row at a time. `act` names what a row does to the state it finds.
_PHASES = f"""WITH RECURSIVE {TELEMETRY},
n AS (SELECT event_id, vehicle, t, depth > 30 AS hit, k % 4 > 0 AS confirmed, k % 10 > 0 AS active, k % 5 AS misses, depth < 60 AS framed, CASE WHEN k > 96 THEN 'budget' END AS release,
  row_number() OVER (PARTITION BY vehicle ORDER BY t, event_id) AS rn FROM telemetry),
r AS (SELECT NULL::BIGINT AS event_id, vehicle, 0::BIGINT AS rn, 'SEARCH' AS state, 0.0::DOUBLE AS since, []::BOOLEAN[] AS hits, NULL::DOUBLE AS held, NULL::DOUBLE AS file, NULL::DOUBLE AS idle, NULL::VARCHAR AS reason, '' AS events FROM n GROUP BY vehicle
UNION ALL
SELECT event_id, vehicle, rn, now, CASE WHEN act IN ('leave', 'acquire', 'track', 'forget', 'lose', 'again', 'end', 'rest') OR now <> state THEN t ELSE since END, CASE WHEN act IN ('forget', 'end', 'rest') THEN []::BOOLEAN[] ELSE hs END, held2,
  CASE WHEN on_ THEN CASE WHEN file IS NULL OR t - file > 300 THEN t ELSE file END WHEN rec = 'stop_recording' THEN NULL ELSE file END, CASE WHEN on_ THEN NULL WHEN file IS NOT NULL THEN coalesce(idle, t) ELSE idle END,
  CASE act WHEN 'leave' THEN release WHEN 'track' THEN NULL WHEN 'end' THEN 'lost' ELSE reason END,
  concat_ws(',', CASE WHEN act IN ('leave', 'end') THEN 'encounter_end' WHEN act = 'track' THEN 'encounter_start' END, rec, CASE WHEN now <> state THEN 'state:' || now END)
FROM (SELECT *, CASE WHEN on_ THEN CASE WHEN file IS NULL THEN 'start_recording' WHEN t - file > 300 THEN 'stop_recording,start_recording' END WHEN file IS NOT NULL AND t - coalesce(idle, t) >= 3 THEN 'stop_recording' END AS rec
FROM (SELECT *, now IN ('TRACK', 'FILM', 'LOST') AS on_
FROM (SELECT *, CASE act WHEN 'leave' THEN 'RELEASE' WHEN 'acquire' THEN 'ACQUIRE' WHEN 'track' THEN 'TRACK' WHEN 'forget' THEN 'SEARCH' WHEN 'lose' THEN 'LOST' WHEN 'off' THEN 'TRACK' WHEN 'hold' THEN CASE WHEN state = 'TRACK' AND t - held2 >= 1 THEN 'FILM' ELSE state END
    WHEN 'again' THEN 'TRACK' WHEN 'end' THEN 'SEARCH' WHEN 'rest' THEN 'SEARCH' ELSE state END AS now
FROM (SELECT *, CASE WHEN act IN ('leave', 'off') THEN NULL WHEN act = 'hold' THEN coalesce(held, t) ELSE held END AS held2
FROM (SELECT *, CASE WHEN state IN ('TRACK', 'FILM', 'LOST') AND release IS NOT NULL THEN 'leave'
    WHEN state = 'SEARCH' THEN CASE WHEN len(list_filter(hs, lambda x: x)) >= 3 THEN 'acquire' END
    WHEN state = 'ACQUIRE' THEN CASE WHEN confirmed THEN 'track' WHEN t - since > 3 OR NOT active THEN 'forget' END
    WHEN state IN ('TRACK', 'FILM') THEN CASE WHEN NOT active OR misses > 2 THEN 'lose' WHEN NOT framed THEN 'off' ELSE 'hold' END
    WHEN state = 'LOST' THEN CASE WHEN active AND confirmed AND misses = 0 THEN 'again' WHEN t - since > 4 THEN 'end' END
    WHEN t - since >= 12 THEN 'rest' END AS act
FROM (SELECT n.event_id, n.vehicle, n.rn, n.t, n.confirmed, n.active, n.misses, n.framed, n.release, r.state, r.since, list_concat(r.hits, [n.hit])[-5:] AS hs, r.held, r.file, r.idle, r.reason FROM r JOIN n ON n.vehicle = r.vehicle AND n.rn = r.rn + 1)))))))
SELECT event_id, state, events, file IS NOT NULL AS recording, reason FROM r WHERE rn > 0"""

QUERIES = {
    "stream_tumbling": Query(
        stream_tumbling,
        """SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events
        GROUP BY 1, 2 HAVING time_bucket(INTERVAL 6 HOURS, any_value(ts), TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""",
    ),
    "stream_session": Query(
        stream_session,
        """WITH g AS (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOURS)::INTEGER, 1) AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
        SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOURS AS session_end, user_id, count(*) AS n, max(value) AS highest FROM s GROUP BY user_id, session
        HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""",
    ),
    "stream_dedup": Query(stream_dedup, "SELECT DISTINCT event_id, user_id, event_type FROM events"),
    "state_phases": Query(state_phases, _PHASES),
    "stream_phases": Query(stream_phases, _PHASES),
    "state_gate": Query(
        state_gate,
        f"""WITH RECURSIVE {TELEMETRY}, n AS (SELECT event_id, vehicle, t, k * 7919 AS h, row_number() OVER (PARTITION BY vehicle ORDER BY t, event_id) AS rn FROM telemetry),
        r AS (SELECT event_id, vehicle, rn, CASE WHEN t + 1e-6 < 0 THEN 0.0::DOUBLE ELSE greatest(1.0::DOUBLE, t + 0.5::DOUBLE) END AS due, CASE WHEN t + 1e-6 >= 0 THEN h END AS last, CASE WHEN t + 1e-6 < 0 THEN 'rate' END AS why FROM n WHERE rn = 1 UNION ALL
          SELECT n.event_id, n.vehicle, n.rn, CASE WHEN n.t + 1e-6 < r.due THEN r.due ELSE greatest(r.due + 1, n.t + 0.5::DOUBLE) END,
            CASE WHEN n.t + 1e-6 < r.due OR bit_count(xor(r.last, n.h)) <= 3 THEN r.last ELSE n.h END, CASE WHEN n.t + 1e-6 < r.due THEN 'rate' WHEN bit_count(xor(r.last, n.h)) <= 3 THEN 'near_dup' END
          FROM r JOIN n ON n.vehicle = r.vehicle AND n.rn = r.rn + 1)
        SELECT event_id, why IS NULL AS kept, why FROM r""",
    ),
    "state_decimate": Query(
        state_decimate,
        f"""WITH RECURSIVE {TELEMETRY}, n AS (SELECT event_id, vehicle, t, row_number() OVER (PARTITION BY vehicle ORDER BY t, event_id) AS rn FROM telemetry),
        r AS (SELECT event_id, vehicle, t, rn, t AS last, TRUE AS kept FROM n WHERE rn = 1 UNION ALL
          SELECT n.event_id, n.vehicle, n.t, n.rn, CASE WHEN n.t - r.last < 2 - 1e-6 THEN r.last ELSE n.t END, n.t - r.last >= 2 - 1e-6 FROM r JOIN n ON n.vehicle = r.vehicle AND n.rn = r.rn + 1)
        SELECT event_id, vehicle FROM r WHERE kept""",
    ),
    "state_segments": Query(
        state_segments,
        f"""WITH {TELEMETRY}, s AS (SELECT *, floor((t - min(t) OVER (PARTITION BY vehicle)) / 30)::BIGINT AS segment FROM telemetry)
        SELECT vehicle, segment, count(*) AS n, round(max(t), 5) AS last FROM s GROUP BY 1, 2""",
    ),
}
