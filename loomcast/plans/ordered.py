"""Queries over telemetry, experiments and ordered sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import joins
from ..operators import telemetry as T
from .base import TELEMETRY, Query, table, telemetry, timed

SEARCHING = ("SEARCH", "ACQUIRE")


def win_dt_state_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.state_seconds(timed(spark, sf_dir), "state", "dt")
    return out.select("state", F.round("seconds", 4).alias("seconds"), F.round("share", 6).alias("share"))


def win_depth_band_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.band_rates(timed(spark, sf_dir), F.col("state").isin(*SEARCHING), F.col("found"), "depth", "dt", 10.0)
    return out.select("band", F.round("seconds", 4).alias("seconds"), "finds", F.round("per_minute", 4).alias("per_minute"))


def win_band_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.band_temperature(telemetry(spark, sf_dir), "depth", "temp", 25.0)
    return out.withColumn("median_temp", F.round("median_temp", 6))


def win_thermocline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.thermocline(T.band_temperature(telemetry(spark, sf_dir), "depth", "temp", 25.0))
    return out.withColumn("step", F.round("step", 6))


def win_look_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).withColumn("cue", F.when(F.col("k") % 3 == 0, "flash").when(F.col("k") % 3 == 1, "weak"))
    return T.look_sessions(rows, "vehicle", "t", "event_id", F.col("depth") > 40, "cue", F.col("state") == "ACQUIRE")


def win_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.idle_sessions(telemetry(spark, sf_dir), "vehicle", "t", "event_id", 1.5)
    return rows.groupBy("vehicle", "session").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 6).alias("length"))


def win_rolling_n_of_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("event_id", "vehicle", F.coalesce(T.n_of_m("vehicle", "t", "event_id", F.col("depth") > 45, 3, 5), F.lit(False)).alias("acquire"))


def win_onset_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).withColumn("onset", T.onset("vehicle", "t", "event_id", F.col("depth") > 60, 3.0))
    return rows.where("onset").select("event_id", "vehicle")


def win_decay_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.decayed_rates(timed(spark, sf_dir), "vehicle", "t", "dt", F.col("found"), T.band(F.col("depth"), 20.0), 20.0)
    return out.select("vehicle", "band", F.round("exposure", 5).alias("exposure"), F.round("events", 5).alias("events"), F.round("per_minute", 6).alias("per_minute"))


def win_sorted_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours up to 64 places apart."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    out = T.sorted_neighbourhood(rows, "source", "h", "doc_id", 64)
    return out


def win_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).withColumn("raw", F.when(F.col("depth") > 30, 1).otherwise(0))
    return T.debounced(rows, "vehicle", "t", "event_id", "raw", 0.5).select("event_id", "raw", "stable")


def win_best_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.best_row(telemetry(spark, sf_dir), ["vehicle", "state"], F.round(F.col("depth"), 0), "event_id", "event_id")
    return out


def win_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.smoothed(telemetry(spark, sf_dir), "vehicle", "t", "event_id", "depth", 0.8)
    return out.select("event_id", F.round("ema", 5).alias("ema"))


def win_rolling_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the last 200 rows."""
    rows = T.rolling_percentiles(telemetry(spark, sf_dir), "vehicle", "t", "event_id", "depth", 200, (0.5, 0.95))
    return rows.select("event_id", F.round(F.col("rolling")[0], 5).alias("p50"), F.round(F.col("rolling")[1], 5).alias("p95"))


def win_running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.over_median(telemetry(spark, sf_dir), "vehicle", "t", "event_id", "depth", 200, 10).select("event_id", F.round("novelty", 5).alias("novelty"))


def win_prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.sum("n_chars").over(w), F.lit(0)).alias("offset"))


def win_missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir).withColumn("mission", T.mission("vehicle", "t", "event_id", (F.col("state") == "SEARCH") & (F.col("k") < 10)))
    return rows.groupBy("vehicle", "mission").agg(F.count("*").alias("n"), F.round(F.sum("dt"), 4).alias("seconds"), F.round(F.max("depth"), 2).alias("deepest"))


def win_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stalled(telemetry(spark, sf_dir), "vehicle", "t", "event_id", "depth", 5.0, 8.0).select("event_id", "stalled")


def win_repeated_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).withColumns({"x": F.when(F.col("k") % 6 > 0, F.col("k") / 100.0), "y": F.col("depth") / 400.0})
    return T.repeated_near(rows, "vehicle", "t", "event_id", "x", "y").select("event_id", "repeated")


def win_sampled_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.sampled_mean(telemetry(spark, sf_dir), "vehicle", "t", "event_id", "depth", 10, 5.0)
    return out.select("vehicle", F.round("t", 6).alias("t"), F.round("mean", 5).alias("mean"))


def agg_duty_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timed(spark, sf_dir).groupBy("state").agg(T.weighted_mean(F.col("k") / 100.0, F.col("dt")).alias("lamp"), T.weighted_mean((F.col("k") > 70).cast("double"), F.col("dt")).alias("dark"))
    return out.select("state", F.round("lamp", 6).alias("lamp"), F.round("dark", 6).alias("dark"))


def join_asof_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir)
    fixes = rows.where("state = 'TRACK'").select("vehicle", "t", "k")
    asks = rows.where("state = 'FILM'").select("vehicle", "t", "event_id")
    return joins.asof_join(asks, fixes, "vehicle", "t", "k", 4.0).select("event_id", F.col("k_asof"))


def join_latest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).withColumns({"heading": F.when(F.col("k") % 5 != 0, F.col("k")), "heading_present": F.col("k") % 2 == 0, "alt": F.col("depth"), "alt_present": F.col("state") == "SEARCH"})
    out = joins.latest_fields(rows, "vehicle", "t", "event_id", ["heading", "alt"], 1.5)
    return out.select("event_id", F.col("heading_now").alias("heading"), F.col("alt_now").alias("alt"))


def encounter_sessionise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of engaged states as encounters: value, behaviour and why they ended."""
    rows = T.sessions(timed(spark, sf_dir), "vehicle", "t", "event_id", F.col("state").isin("TRACK", "FILM")).where("session is not null")
    each = rows.groupBy("vehicle", "session").agg(F.sum("dt").alias("engaged"), F.sum(F.when(F.col("state") == "FILM", F.col("dt")).otherwise(0.0)).alias("good"), F.count_if(F.col("k") > 60).alias("crowded"), F.count("*").alias("seen"))
    value = C.footage_value(F.lit(1.0), F.col("good"), 3.0)
    reason = C.leave_reason(F.col("engaged"), F.col("good"), C.marginal_rate(F.lit(1.0), F.lit(1.0), F.col("good"), 3.0), F.lit(0.2), 6.0, 1.5, 0.5)
    return each.select("vehicle", "session", F.round("engaged", 4).alias("engaged"), F.round(value, 5).alias("value"), F.coalesce(reason, F.lit("lost")).alias("reason"), C.behaviour(F.col("seen"), F.col("crowded"), F.lit(False), F.coalesce(reason, F.lit("lost")), 0.5).alias("behaviour"))


def agg_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encounter_sessionise(spark, sf_dir).groupBy("reason", "behaviour").agg(F.count("*").alias("n"), F.round(F.median("engaged"), 4).alias("median_engaged"), F.round(F.sum("value"), 3).alias("value"))


def agg_sim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animals (orders) of runs (customers): value with diminishing returns, filmed and distinct ones."""
    good = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity") / 20.0).alias("good"))
    runs = table(spark, sf_dir, "orders").join(good, F.col("o_orderkey") == F.col("l_orderkey"))
    out = runs.groupBy("o_custkey").agg(F.sum(1.0 - F.exp(-F.col("good") / 5.0)).alias("value"), F.count_if(F.col("good") >= 3).alias("filmed"), F.countDistinct("o_orderpriority").alias("kinds"))
    return out.withColumn("value", F.round("value", 5))


def agg_mean_sd_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("error", F.col("o_orderkey") % 97 == 0)
    ok = F.when(~F.col("error"), F.col("o_totalprice"))
    out = rows.groupBy("o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 400).alias("setting")).agg(F.avg(ok).alias("mean"), F.coalesce(F.stddev_samp(ok), F.lit(0.0)).alias("sd"), F.count(ok).alias("runs"), F.count_if("error").alias("errors"))
    return out.where("runs > 0").withColumns({"mean": F.round("mean", 5), "sd": F.round("sd", 5)})


def agg_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("value", F.array(*map(F.lit, (0.5, 0.9, 0.99))))
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), q.alias("q"))
    return out.select("event_type", "n", F.round("mean", 5).alias("mean"), *[F.round(F.col("q")[i], 5).alias(f"p{p}") for i, p in enumerate((50, 90, 99))], F.round(1000.0 / F.col("mean"), 4).alias("fps"))


def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("p_brand", F.col("rank").cast("long").alias("rank"), "l_orderkey", "l_linenumber", "l_extendedprice")


def retention_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400.0
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t0"), (F.col("l_quantity") * 10).cast("long").alias("bytes"), F.when(F.col("l_linenumber") < 7, day).alias("t1"), (F.col("l_returnflag") == "R").alias("animal"))
    rows = rows.groupBy("l_suppkey", "t0").agg(F.max("bytes").alias("bytes"), F.max("t1").alias("t1"), F.max("animal").alias("animal"))
    return T.retention(rows, "l_suppkey", "t0", "bytes", "t1", F.col("animal"), 100.0, 1500.0, 11000.0).select("l_suppkey", "t0", "delete")


def sequence_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"), F.lag("role").over(w).alias("before"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.col("n").cast("long")).alias("chars"), F.count_if(F.col("role") == F.col("before")).alias("repeats"))


_SESSION = f"""{TELEMETRY},
flagged AS (SELECT *, state IN ('TRACK', 'FILM') AS act, lag(state IN ('TRACK', 'FILM')) OVER (PARTITION BY vehicle ORDER BY t, event_id) AS was FROM timed),
numbered AS (SELECT *, sum((act AND NOT coalesce(was, FALSE))::INTEGER) OVER (PARTITION BY vehicle ORDER BY t, event_id) AS session FROM flagged),
each AS (SELECT vehicle, session::BIGINT AS session, sum(dt) AS e, sum(CASE WHEN state = 'FILM' THEN dt ELSE 0 END) AS g, count(*) FILTER (k > 60) AS crowded, count(*) AS seen FROM numbered WHERE act GROUP BY 1, 2),
told AS (SELECT *, CASE WHEN e >= 6 THEN 'budget' WHEN e >= 1.5 AND g < 1 THEN 'no_shot' WHEN e >= 0.5 AND exp(-g / 3.0::DOUBLE) / 3.0::DOUBLE < 0.2 THEN CASE WHEN g >= 1 THEN 'enough' ELSE 'no_shot' END ELSE 'lost' END AS reason FROM each),
encounters AS (SELECT vehicle, session, round(e, 4) AS engaged, round(1 - exp(-g / 3.0::DOUBLE), 5) AS value, reason, CASE WHEN crowded >= 0.5 * seen THEN 'swarm' WHEN reason = 'lost' THEN 'mobile' ELSE 'drifter' END AS behaviour FROM told)"""

QUERIES = {
    "win_dt_state_seconds": Query(win_dt_state_seconds, f"WITH {TELEMETRY} SELECT state, round(sum(dt), 4) AS seconds, round(sum(dt) / (SELECT sum(dt) FROM timed), 6) AS share FROM timed GROUP BY 1"),
    "win_depth_band_rates": Query(
        win_depth_band_rates,
        f"""WITH {TELEMETRY} SELECT floor(depth / 10) * 10.0::DOUBLE AS band, round(sum(dt), 4) AS seconds, count(*) FILTER (found) AS finds,
        round(CASE WHEN sum(dt) > 0 THEN count(*) FILTER (found) / (sum(dt) / 60) END, 4) AS per_minute FROM timed WHERE state IN ('SEARCH', 'ACQUIRE') GROUP BY 1""",
    ),
    "win_band_temperature": Query(win_band_temperature, f"WITH {TELEMETRY} SELECT floor(depth / 25) * 25.0::DOUBLE AS band, round(median(temp), 6) AS median_temp, count(*) AS samples FROM telemetry WHERE temp IS NOT NULL GROUP BY 1"),
    "win_thermocline": Query(
        win_thermocline,
        f"""WITH {TELEMETRY}, b AS (SELECT floor(depth / 25) * 25.0::DOUBLE AS band, median(temp) AS m FROM telemetry WHERE temp IS NOT NULL GROUP BY 1),
        s AS (SELECT lag(band) OVER (ORDER BY band) AS upper, band AS lower, abs(m - lag(m) OVER (ORDER BY band)) AS step FROM b)
        SELECT upper, lower, round(step, 6) AS step FROM s WHERE upper IS NOT NULL AND step >= 0.5 ORDER BY s.step DESC, upper DESC LIMIT 1""",
    ),
    "win_look_sessions": Query(
        win_look_sessions,
        f"""WITH {TELEMETRY}, f AS (SELECT *, depth > 40 AS looking, CASE k % 3 WHEN 0 THEN 'flash' WHEN 1 THEN 'weak' END AS cue FROM telemetry),
        l AS (SELECT *, coalesce(lag(looking) OVER w, FALSE) AS was FROM f WINDOW w AS (PARTITION BY vehicle ORDER BY t, event_id)),
        n AS (SELECT *, sum((looking AND NOT was)::INTEGER) OVER (PARTITION BY vehicle ORDER BY t, event_id) AS session FROM l),
        p AS (SELECT *, lag(session) OVER (PARTITION BY vehicle ORDER BY t, event_id) AS before FROM n),
        c AS (SELECT vehicle, session, coalesce(arg_min(coalesce(cue, '?'), event_id), '?') AS cue FROM p WHERE looking GROUP BY 1, 2),
        h AS (SELECT DISTINCT vehicle, before AS session, 1 AS hit FROM p WHERE was AND state = 'ACQUIRE')
        SELECT cue, count(*) AS looks, count(hit) AS finds FROM c LEFT JOIN h USING (vehicle, session) GROUP BY 1""",
    ),
    "win_idle_sessions": Query(
        win_idle_sessions,
        f"""WITH {TELEMETRY}, g AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY vehicle ORDER BY t, event_id) > 1.5)::INTEGER, 1) AS new FROM telemetry),
        s AS (SELECT *, sum(new) OVER (PARTITION BY vehicle ORDER BY t, event_id) AS session FROM g)
        SELECT vehicle, session::BIGINT AS session, count(*) AS n, round(max(t) - min(t), 6) AS length FROM s GROUP BY 1, 2""",
    ),
    "win_rolling_n_of_m": Query(win_rolling_n_of_m, f"WITH {TELEMETRY} SELECT event_id, vehicle, sum((depth > 45)::INTEGER) OVER (PARTITION BY vehicle ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 AS acquire FROM telemetry"),
    "win_onset_gap": Query(
        win_onset_gap,
        f"""WITH {TELEMETRY}, l AS (SELECT *, max(CASE WHEN depth > 60 THEN t END) OVER (PARTITION BY vehicle ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM telemetry)
        SELECT event_id, vehicle FROM l WHERE depth > 60 AND (last IS NULL OR t - last > 3)""",
    ),
    "win_decay_rates": Query(
        win_decay_rates,
        f"""WITH {TELEMETRY}, m AS (SELECT *, pow(0.5::DOUBLE, (max(t) OVER (PARTITION BY vehicle) - t) / 20.0::DOUBLE) AS fade FROM timed),
        s AS (SELECT vehicle, floor(depth / 20) * 20.0::DOUBLE AS band, sum(dt * fade) AS exposure, sum(found::INTEGER * fade) AS events FROM m GROUP BY 1, 2)
        SELECT vehicle, band, round(exposure, 5) AS exposure, round(events, 5) AS events, round(60 * (events + 0.05::DOUBLE) / (exposure + 60), 6) AS per_minute FROM s""",
    ),
    "win_sorted_neighbourhood": Query(
        win_sorted_neighbourhood,
        """WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(text), doc_id) AS rn FROM documents)
        SELECT a.source, a.doc_id AS a, b.doc_id AS b FROM n a JOIN n b ON a.source = b.source AND b.rn - a.rn BETWEEN 1 AND 64""",
    ),
    "win_debounce": Query(
        win_debounce,
        f"""WITH {TELEMETRY}, r AS (SELECT *, (depth > 30)::INTEGER AS raw FROM telemetry), c AS (SELECT *, coalesce((lag(raw) OVER (PARTITION BY vehicle ORDER BY t, event_id) <> raw)::INTEGER, 1) AS ch FROM r),
        i AS (SELECT *, sum(ch) OVER (PARTITION BY vehicle ORDER BY t, event_id) AS island FROM c)
        SELECT event_id, raw, CASE WHEN t - min(t) OVER (PARTITION BY vehicle, island) >= 0.5 THEN raw END AS stable FROM i""",
    ),
    "win_best_frame": Query(win_best_frame, f"WITH {TELEMETRY}, n AS (SELECT *, row_number() OVER (PARTITION BY vehicle, state ORDER BY round(depth, 0) DESC, event_id) AS rn FROM telemetry) SELECT vehicle, state, event_id AS best_t, round(depth, 0) AS best_score FROM n WHERE rn = 1"),
    "win_smoothed": Query(
        win_smoothed,
        f"""WITH RECURSIVE {TELEMETRY}, n AS (SELECT event_id, vehicle, t, depth, row_number() OVER (PARTITION BY vehicle ORDER BY t, event_id) AS rn FROM telemetry),
        r AS (SELECT event_id, vehicle, t, rn, depth AS ema FROM n WHERE rn = 1 UNION ALL
          SELECT n.event_id, n.vehicle, n.t, n.rn, r.ema + (1 - exp(-(n.t - r.t) / 0.8::DOUBLE)) * (n.depth - r.ema) FROM r JOIN n ON n.vehicle = r.vehicle AND n.rn = r.rn + 1)
        SELECT event_id, round(ema, 5) AS ema FROM r""",
    ),
    "win_rolling_latency": Query(
        win_rolling_latency,
        f"""WITH {TELEMETRY} SELECT event_id, round(quantile_cont(depth, 0.5) OVER w, 5) AS p50, round(quantile_cont(depth, 0.95) OVER w, 5) AS p95 FROM telemetry
        WINDOW w AS (PARTITION BY vehicle ORDER BY t, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""",
    ),
    "win_running_median": Query(
        win_running_median,
        f"""WITH {TELEMETRY}, m AS (SELECT event_id, depth, median(depth) OVER w AS m, count(*) OVER w AS n FROM telemetry WINDOW w AS (PARTITION BY vehicle ORDER BY t, event_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))
        SELECT event_id, round(depth / m, 5) AS novelty FROM m WHERE n >= 10 AND m > 0""",
    ),
    "win_prefix_offsets": Query(win_prefix_offsets, 'SELECT doc_id, source, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM documents'),
    "win_missions": Query(
        win_missions,
        f"""WITH {TELEMETRY}, m AS (SELECT *, sum((state = 'SEARCH' AND k < 10)::INTEGER) OVER (PARTITION BY vehicle ORDER BY t, event_id) AS mission FROM timed)
        SELECT vehicle, mission::BIGINT AS mission, count(*) AS n, round(sum(dt), 4) AS seconds, round(max(depth), 2) AS deepest FROM m GROUP BY 1, 2""",
    ),
    "win_stalled": Query(
        win_stalled,
        f"""WITH {TELEMETRY}, l AS (SELECT *, floor((first_value(depth) OVER w - min(depth) OVER w) / 5) AS level FROM telemetry WINDOW w AS (PARTITION BY vehicle ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT event_id, t - min(t) OVER (PARTITION BY vehicle, level) > 8 AS stalled FROM l""",
    ),
    "win_repeated_near": Query(
        win_repeated_near,
        f"""WITH {TELEMETRY}, p AS (SELECT event_id, vehicle, CASE WHEN k % 6 > 0 THEN k / 100.0::DOUBLE END AS x, depth / 400.0::DOUBLE AS y, row_number() OVER (PARTITION BY vehicle ORDER BY t, event_id) AS rn FROM telemetry)
        SELECT a.event_id, a.x IS NOT NULL AND count(*) FILTER (sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.15::DOUBLE) >= 2 AS repeated FROM p a JOIN p b ON a.vehicle = b.vehicle AND b.rn BETWEEN a.rn - 2 AND a.rn GROUP BY a.event_id, a.x""",
    ),
    "win_sampled_mean": Query(
        win_sampled_mean,
        f"""WITH {TELEMETRY}, m AS (SELECT vehicle, t, avg(depth) OVER (PARTITION BY vehicle ORDER BY t, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean, floor(t / 5) AS slot, lag(floor(t / 5)) OVER (PARTITION BY vehicle ORDER BY t, event_id) AS before FROM telemetry)
        SELECT vehicle, round(t, 6) AS t, round(mean, 5) AS mean FROM m WHERE before IS NULL OR slot <> before""",
    ),
    "agg_duty_weighted": Query(agg_duty_weighted, f"WITH {TELEMETRY} SELECT state, round(sum(k / 100.0::DOUBLE * dt) / sum(dt), 6) AS lamp, round(sum((k > 70)::INTEGER * dt) / sum(dt), 6) AS dark FROM timed GROUP BY 1"),
    "join_asof_last_value": Query(
        join_asof_last_value,
        f"""WITH {TELEMETRY}, a AS (SELECT vehicle, t, event_id FROM telemetry WHERE state = 'FILM'), f AS (SELECT vehicle, t, k FROM telemetry WHERE state = 'TRACK')
        SELECT event_id, CASE WHEN a.t - f.t <= 4 THEN k END AS k_asof FROM a ASOF LEFT JOIN f ON a.vehicle = f.vehicle AND a.t >= f.t""",
    ),
    "join_latest_fields": Query(
        join_latest_fields,
        f"""WITH {TELEMETRY}, p AS (SELECT event_id, t, max(CASE WHEN k % 2 = 0 THEN event_id END) OVER w AS h, max(CASE WHEN state = 'SEARCH' THEN event_id END) OVER w AS a FROM telemetry
          WINDOW w AS (PARTITION BY vehicle ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT p.event_id, CASE WHEN p.t - x.t <= 1.5 AND x.k % 5 <> 0 THEN x.k END AS heading, CASE WHEN p.t - y.t <= 1.5 THEN y.depth END AS alt
        FROM p LEFT JOIN telemetry x ON x.event_id = p.h LEFT JOIN telemetry y ON y.event_id = p.a""",
    ),
    "encounter_sessionise": Query(encounter_sessionise, f"WITH {_SESSION} SELECT * FROM encounters"),
    "agg_encounters": Query(agg_encounters, f"WITH {_SESSION} SELECT reason, behaviour, count(*) AS n, round(median(engaged), 4) AS median_engaged, round(sum(value), 3) AS value FROM encounters GROUP BY 1, 2"),
    "agg_sim_scores": Query(
        agg_sim_scores,
        """WITH g AS (SELECT l_orderkey, sum(l_quantity) / 20.0::DOUBLE AS good FROM lineitem GROUP BY 1)
        SELECT o_custkey, round(sum(1 - exp(-good / 5.0::DOUBLE)), 5) AS value, count(*) FILTER (good >= 3) AS filmed, count(DISTINCT o_orderpriority) AS kinds FROM orders JOIN g ON o_orderkey = l_orderkey GROUP BY 1""",
    ),
    "agg_mean_sd_grid": Query(
        agg_mean_sd_grid,
        """SELECT o_orderstatus, o_orderpriority, o_custkey % 400 AS setting, round(avg(o_totalprice) FILTER (o_orderkey % 97 <> 0), 5) AS mean, round(coalesce(stddev_samp(o_totalprice) FILTER (o_orderkey % 97 <> 0), 0.0), 5) AS sd,
        count(*) FILTER (o_orderkey % 97 <> 0) AS runs, count(*) FILTER (o_orderkey % 97 = 0) AS errors FROM orders GROUP BY 1, 2, 3 HAVING count(*) FILTER (o_orderkey % 97 <> 0) > 0""",
    ),
    "agg_latency_percentiles": Query(agg_latency_percentiles, "SELECT event_type, count(*) AS n, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.9), 5) AS p90, round(quantile_cont(value, 0.99), 5) AS p99, round(1000 / avg(value), 4) AS fps FROM events GROUP BY 1"),
    "topk_per_group": Query(
        topk_per_group,
        """SELECT p_brand, rank, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank, l_orderkey, l_linenumber, l_extendedprice
        FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE rank <= 3""",
    ),
    "retention_policy": Query(
        retention_policy,
        """WITH s AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS t0, max((l_quantity * 10)::BIGINT) AS bytes, max(CASE WHEN l_linenumber < 7 THEN epoch(l_shipdate) / 86400.0::DOUBLE END) AS t1, bool_or(l_returnflag = 'R') AS animal FROM lineitem GROUP BY 1, 2),
        o AS (SELECT *, coalesce(t1 < 11000 AND NOT animal, FALSE) AS open FROM s)
        SELECT l_suppkey, t0, open AND 100 + coalesce(sum(CASE WHEN open THEN bytes ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY t0, bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 1500 AS delete FROM o""",
    ),
    "sequence_turns": Query(
        sequence_turns,
        """SELECT conv_id, count(*) AS turns, sum(n)::BIGINT AS chars, count(*) FILTER (role = before) AS repeats
        FROM (SELECT conv_id, role, length(text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1""",
    ),
}
