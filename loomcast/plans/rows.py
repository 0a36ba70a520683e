"""Queries of which rows an evaluation or a probe takes, of names, rates and choices, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import curation, dive, experiments, joins, patches, planner, probes, selection
from .base import BUCKETED, TELEMETRY, Query, bucketed, table, telemetry, timed
from .curation import _NEAR

E = lambda i: F.element_at("embedding", i).cast("double")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rows of an index: a box for every other label, masks, splits, sources and labels."""
    v, label = F.col("vec_id"), F.col("label")
    x, y = F.abs(E(1)) * 0.5, F.abs(E(2)) * 0.5
    box = F.array(F.array(x, y, x + 0.3, y + 0.2))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.concat(F.lit("e-"), v.cast("string")).alias("image_id"),
        F.when(v % 5 == 0, "test").when(v % 5 == 1, "val").otherwise("train").alias("split"),
        F.concat(F.lit("src"), (v % 4).cast("string")).alias("source"),
        F.when(label % 3 == 0, -1).when(label % 3 == 1, 1).otherwise(0).alias("frame_label"),
        F.when(label % 2 == 1, box).otherwise(F.array().cast("array<array<double>>")).alias("boxes"),
        F.when(label % 2 == 1, F.array(F.concat(F.lit("c"), (v % 6).cast("string")))).otherwise(F.array().cast("array<string>")).alias("box_labels"),
        F.when(label % 2 == 1, F.array(v % 3 > 0)).otherwise(F.array().cast("array<boolean>")).alias("box_is_animal"),
        F.when(v % 7 == 0, "m.png").when(v % 7 == 1, "").alias("mask_path"),
        (v % 3 > 0).alias("train_commercial_ok"),
        (E(3) * 10).alias("weight"),
        F.lit(100).alias("width"),
        F.lit(80).alias("height"),
        F.concat(F.lit("p/"), v.cast("string")).alias("path"),
    )


FRAMES = """
frames AS (SELECT vec_id, 'e-' || vec_id AS image_id, CASE vec_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, 'src' || (vec_id % 4) AS source,
  CASE label % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS frame_label, label % 2 = 1 AS boxed, vec_id % 3 > 0 AS ok, CASE vec_id % 7 WHEN 0 THEN 'm.png' WHEN 1 THEN '' END AS mask_path,
  embedding[3]::DOUBLE * 10 AS weight, 'c' || (vec_id % 6) AS concept, 'p/' || vec_id AS path, abs(embedding[1]::DOUBLE) * 0.5::DOUBLE AS x, abs(embedding[2]::DOUBLE) * 0.5::DOUBLE AS y FROM embeddings)"""


def rows_frame_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [selection.frame_rows(frames(spark, sf_dir), s).select("image_id", "split", "source", "frame_label") for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rows_patch_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.patch_rows(frames(spark, sf_dir), "test").select("image_id", "frame_label")


def rows_probe_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.labelled_rows(frames(spark, sf_dir)).select("image_id", "split")


def rows_training_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.pool(frames(spark, sf_dir), True, ["src1", "src2", "src3"]).select("image_id", F.round("weight", 6).alias("weight"))


def rows_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.parity_rows(frames(spark, sf_dir)).select("image_id", "frame_label")


def rows_sprites(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxa = spark.createDataFrame([("c0", "fish"), ("c1", "squid"), ("c2", "medusa"), ("c4", "shrimp")], "concept string, taxon string")
    return selection.sprites(frames(spark, sf_dir), ["src0", "src1", "src2"], "train", 15, taxa).select("image_id", "concept", "taxon")


def filter_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumns({"p": C.sigmoid(E(1) * 8), "peak": C.sigmoid(E(2) * 8), "found": F.col("vec_id") % 4 > 0, "cx": E(3) + 0.5, "cy": E(4) + 0.5, "s": F.abs(E(5))})
    return rows.select("vec_id", C.detected(F.col("p"), F.col("peak"), F.col("found")).alias("detected"), C.well_framed(F.col("found"), F.col("p"), F.col("cx"), F.col("cy"), F.col("s")).alias("framed"), C.good_view(F.col("p"), F.col("s") * 40, E(3), E(4)).alias("good"))


def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("doc_id") % 11 == 0, "no such file").when(F.col("doc_id") % 11 == 1, "")
    return table(spark, sf_dir, "documents").select("doc_id", error.alias("metric_error")).select("doc_id", F.when(C.has_text(F.col("metric_error")), "unreadable").alias("removed_reason"))


def bands_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every hour and band: whether animals cross, the prior, and whether the band can be reached."""
    rows = telemetry(spark, sf_dir).select((F.col("k") % 24 + 0.5).alias("hour"), (F.floor(F.col("depth") / 10) * 10 + 5.0).alias("band")).distinct()
    return rows.select("hour", "band", planner.crossing(F.col("hour")).alias("crossing"), F.round(planner.diel_prior(F.col("band"), F.col("hour")), 6).alias("prior"), planner.reachable(F.col("band"), F.lit(30.0), F.lit(120.0)).alias("reachable"))


def bands_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir).groupBy("vehicle", (F.floor(F.col("depth") / 10) * 10 + 5.0).alias("band")).agg(F.count_if("found").cast("double").alias("events"), F.sum("dt").alias("exposure"))
    rows = rows.select("vehicle", "band", "events", F.round("exposure", 4).alias("exposure"), planner.diel_prior(F.col("band"), F.lit(1.5)).alias("prior"), planner.reachable(F.col("band"), F.lit(30.0), F.lit(120.0)).alias("reachable"))
    return planner.best_band(rows, "vehicle")


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(C.warmup_cosine(step, 400, 9000, 1e-3, 2e-4, 1e-6), 10).alias("lr"), F.round(C.cosine_between(step, 9000, 0.04, 0.4), 8).alias("decay"), F.round(C.linear_between(step, 9000, 0.996, 1.0), 8).alias("momentum"))


def leave_and_behave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When to leave and how an animal behaved, of each order as an encounter of its lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity") * 1.0).alias("engaged"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("good"), F.count("*").alias("seen"), F.count_if(F.col("l_quantity") > 40).alias("crowded"))
    long_run = C.long_run_rate(F.col("good") / 40.0, F.col("engaged"))
    reason = F.coalesce(C.leave_reason(F.col("engaged"), F.col("good"), C.marginal_rate(F.lit(1.0), F.lit(1.0), F.col("good")), long_run), F.lit("lost"))
    ended = C.end_reason(reason, F.col("seen") * 3.0)
    return lines.select("l_orderkey", reason.alias("reason"), ended.alias("ended"), C.behaviour(F.col("seen"), F.col("crowded"), F.col("good") > 100, ended).alias("behaviour"), F.round(C.leave_time(long_run + 0.001), 5).alias("leave_s"))


def throttle_and_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.col("k").bitwiseXOR(F.shiftleft(F.col("k") % 16, 16))
    return telemetry(spark, sf_dir).select("event_id", F.array_join(C.throttle_flags(word), "; ").alias("flags"), F.round(C.storage_hours(F.col("depth") * 1e9, 8e6), 5).alias("hours"))


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of midwater animals by their ancestors; parts as concepts, two names each."""
    names = ["Teleostei", "Cephalopoda", "Siphonophorae", "Ctenophora", "Hydrozoa", "Mysida", "Decapoda", "Brachyura", "Porifera", "Chondrichthyes", "Scyphozoa"]
    k = F.col("p_partkey")
    pick = lambda i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", C.sprite_group(F.array(F.lit("Animalia"), pick(k), pick(F.floor(k / 11)))).alias("taxon"))


def names_and_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe paths, clips, habitats, days, dates in names and the splits that names tell, of all parts."""
    k = F.col("p_partkey")
    key = k.cast("string")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("\\a\\..\\", "/b/", "c/../", "//d\\"))), (k % 4 + 1).cast("int")), F.translate("p_name", " ", "_"), F.lit("/x"), key)
    id_ = F.concat(F.lit("h"), (k % 7).cast("string"), F.element_at(F.array(*map(F.lit, ("/valid/", "/empty/", "/Images/", "/"))), (k % 4 + 1).cast("int")), F.translate("p_name", " ", "_"), F.lit("_"), key)
    stamp = F.concat(F.lit("20"), two(k % 30), F.lit("-"), two(k % 12 + 1), F.lit("-"), two(k % 28 + 1), F.lit("T"), two(k % 24), F.lit(":05:09"))
    named = F.concat(F.lit("cam_"), F.when(k % 5 == 0, F.translate(stamp, "-T:", "")).when(k % 5 == 1, F.translate(stamp, "-T:", "__.")).when(k % 5 == 2, stamp).otherwise("none"), F.lit(".mp4"))
    hint = F.concat(F.element_at(F.array(*map(F.lit, ("d/train/", "TEST", "x/Validation_", "e/"))), (k % 4 + 1).cast("int")), key)
    return table(spark, sf_dir, "part").select("p_partkey", C.safe_relative(path).alias("safe"), C.first_parts(C.safe_relative(path), 2).alias("clip"), C.habitat(id_).alias("habitat"), C.day_of(F.when(k % 9 > 0, stamp)).alias("day"), C.date_in_name(named).alias("taken"), C.split_from_path(hint).alias("split"))


def site_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    url = F.when(p % 3 == 0, F.concat(F.lit("http://h/x/EX"), p.cast("string"), F.lit(".png"))).when(p % 3 == 1, F.concat(F.lit("http://h/a/dive_frame_"), p.cast("string"), F.lit(".png?x=1"))).otherwise(F.concat(F.lit("http://h/b/im"), F.lit("a"), F.lit(".png")))
    day = F.concat(F.lit("2021-03-"), F.lpad((p % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00"))
    group = C.site_group("site", url, F.when(p % 4 > 0, day), F.when(p % 7 > 0, (p % 90) + 0.25), F.when(p % 7 > 0, -((p % 180) + 0.75)), F.when(p % 5 > 0, F.concat(F.lit("u"), (p % 3).cast("string"))))
    return table(spark, sf_dir, "pages").select("page_id", group.alias("grp"))


def blob_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the vectors of a label, as places with a mass: the nearest to the middle, or the heaviest."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", (E(1) + 0.5).alias("cx"), (E(2) + 0.5).alias("cy"), (F.abs(E(3)) * 10).alias("mass"))
    near = joins.pick_near(rows, ["label"], "cx", "cy", "mass", "vec_id", (F.lit(0.6), F.lit(0.6)), 0.05)
    heavy = joins.pick_near(rows, ["label"], "cx", "cy", "mass", "vec_id")
    return near.select("label", F.col("vec_id").alias("near_id")).join(heavy.select("label", F.col("vec_id").alias("heavy_id")), "label")


def results_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by type and size of parts, with the cost of what they are named by where one is known."""
    results = table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.round(F.sum("p_retailprice"), 2).alias("value"))
    costs = table(spark, sf_dir, "part").where("p_size > 20").groupBy(F.concat_ws("_", "p_type", F.col("p_size").cast("string")).alias("model")).agg(F.count("*").alias("fps"))
    return experiments.with_costs(results, costs, ["p_type", "p_size"]).select("p_type", "p_size", "value", "fps")


def results_against(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by priority and status against the first priority's."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    out = experiments.against(rows, "o_orderpriority", "1-URGENT", ["o_orderstatus"], ["value"])
    return out.select("o_orderpriority", "o_orderstatus", "value", F.round("delta_value", 4).alias("delta"))


def thresholds_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = curation.thresholds_of(bucketed(spark, sf_dir), curation.Settings(calibrate=True))
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in t.items()], "name string, value double")


def encounter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounters by reason and by behaviour, over orders as encounters."""
    rows = leave_and_behave(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("engaged_s"), (F.col("o_totalprice") / 3000).alias("good_s")), F.col("l_orderkey") == F.col("o_orderkey"))
    parts = [dive.by_reason(rows, c).select(F.lit(c).alias("by"), F.col(c).alias("key"), "encounters", F.round("median_engaged_s", 4).alias("median_engaged_s"), F.round("median_good_s", 4).alias("median_good_s")) for c in ("ended", "behaviour")]
    return parts[0].unionByName(parts[1])


def value_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footage value an hour of mission, without the time before it."""
    rows = telemetry(spark, sf_dir).select("event_id", "t", F.when(F.col("state") == "SAFE", "SAFE").otherwise(F.col("state")).alias("state"), F.when((F.col("state") == "SEARCH") & (F.col("k") < 10), F.array(F.lit("mission_start"))).alias("events"), F.col("event_id").alias("frame"))
    out = dive.mission(dive.timed(rows))
    return out.select("frames", F.round("minutes", 4).alias("minutes"), F.round("outside_minutes", 4).alias("outside_minutes"), F.round("mission_hours", 6).alias("mission_hours"), "missions")


def spread_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir)
    parts = [dive.spread(rows, c).select(F.lit(c).alias("measure"), *[F.round(p, 6).alias(p) for p in ("p5", "p50", "p95")]) for c in ("depth", "temp")]
    return parts[0].unionByName(parts[1])


def frames_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames numbered by time over all vehicles, by ranges of time."""
    from ..operators.ordering import totals_before

    out = totals_before(telemetry(spark, sf_dir).select("event_id", "t"), [F.col("t"), F.col("event_id")], {"place": F.lit(1)})
    return out.select("event_id", F.col("place").cast("long").alias("place"))


def tail_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 64 frames of each vehicle."""
    from pyspark.sql import Window

    w = Window.partitionBy("vehicle").orderBy(F.desc("t"), F.desc("event_id"))
    return telemetry(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 64").select("event_id", "vehicle")


def heat_max_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    heat = F.transform("embedding", lambda x: C.sigmoid(x.cast("double") * 8))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("label") % 2).cast("int").alias("y"), F.explode(heat).alias("p"))
    out = patches.max_heat_auc(rows, "vec_id", "y")
    return out.select("n", "n_pos", F.round("auc", 6).alias("auc"))


def mask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a sample of a grid of 8 x 8 has each cell as target and as context."""
    from ..operators.robustness import coverage_of_masks

    return coverage_of_masks(8, 8, 20, spark, 64).select("cell", F.round("target", 6).alias("target"), F.round("context", 6).alias("context"))


def robustness_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well contrast tells pictures with animals, under each degradation and severity."""
    from ..operators import images, robustness

    scenes = images.scenes(spark, 24)
    truth = scenes.select("path", (F.size("boxes") > 0).cast("int").alias("y"))
    out = robustness.sweep(scenes, truth, lambda x: float(x.std()))
    return out.select("operation", "level", "n", F.round("auc", 6).alias("auc"))


def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.label_stats(frames(spark, sf_dir))


def layer_and_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The migrating layer and the light at the surface at the hour of each event."""
    from ..operators import simulate

    hour = F.col("k") % 24 + F.col("depth") / 1000
    rows = telemetry(spark, sf_dir).select("event_id", hour.alias("hour"))
    return rows.select("event_id", F.round(simulate.layer_depth(simulate.Sea(), F.col("hour")), 4).alias("layer"), F.round(F.log10(simulate.surface_light(F.col("hour"))), 6).alias("light"))


def dedup_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of near hashes whose lengths confirm the pair."""
    from ..operators import dedup
    from .curation import _near_hashes

    rows = _near_hashes(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    confirm = (F.abs(F.col("a_n_chars") - F.col("b_n_chars")) <= 10) & (F.col("a_lang") == F.col("b_lang"))
    return dedup.near_duplicate_clusters(rows, "doc_id", "h", 6, confirm).select("doc_id", "dup_cluster")


_TAX = ["Teleostei", "Cephalopoda", "Siphonophorae", "Ctenophora", "Hydrozoa", "Mysida", "Decapoda", "Brachyura", "Porifera", "Chondrichthyes", "Scyphozoa"]
_GROUPS = "CASE WHEN list_has_any(a, ['Teleostei', 'Chondrichthyes']) THEN 'fish' WHEN list_has_any(a, ['Cephalopoda']) THEN 'squid' WHEN list_has_any(a, ['Siphonophorae']) THEN 'siphonophore' WHEN list_has_any(a, ['Ctenophora']) THEN 'ctenophore' WHEN list_has_any(a, ['Scyphozoa', 'Hydrozoa']) THEN 'medusa' WHEN list_has_any(a, ['Mysida']) THEN 'shrimp' WHEN list_has_any(a, ['Decapoda']) AND NOT list_has_any(a, ['Brachyura']) THEN 'shrimp' END"
_PRIOR = lambda hour, band: f"CASE WHEN {_CROSS(hour)} THEN CASE WHEN {band} BETWEEN 100 AND 200 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END WHEN {hour} < 6.5 OR {hour} >= 18.5 THEN exp(-0.5::DOUBLE * (({band} - 60) / 40.0::DOUBLE) ** 2) * 2 + 0.5::DOUBLE ELSE 1.0::DOUBLE END"
_AFTER = lambda hour, mark: f"({hour} - {mark} + 12 - 24 * floor(({hour} - {mark} + 12) / 24.0::DOUBLE) - 12)"
_CROSS = lambda hour: f"({_AFTER(hour, '18.5::DOUBLE')} BETWEEN -1.0 AND 1.5 OR {_AFTER(hour, '6.5::DOUBLE')} BETWEEN -2.5 AND 0.5)"
_LINES = """l AS (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS e, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::DOUBLE AS g, count(*) AS seen, count(*) FILTER (l_quantity > 40) AS crowded FROM lineitem GROUP BY 1),
lr AS (SELECT *, (g / 40.0::DOUBLE + (1 / 300.0::DOUBLE) * 1800) / (e + 1800) AS rate FROM l),
re AS (SELECT *, CASE WHEN e >= 180 THEN 'budget' WHEN e >= 30 AND g < 1 THEN 'no_shot' WHEN e >= 10 AND exp(-g / 30.0::DOUBLE) / 30.0::DOUBLE < rate THEN CASE WHEN g >= 1 THEN 'enough' ELSE 'no_shot' END ELSE 'lost' END AS reason FROM lr),
en AS (SELECT *, CASE WHEN reason = 'lost' AND seen * 3.0 <= 10 THEN 'fled' ELSE reason END AS ended FROM re),
be AS (SELECT *, CASE WHEN crowded >= 0.3::DOUBLE * seen THEN 'swarm' WHEN g > 100 OR ended IN ('fled', 'lost') THEN 'mobile' ELSE 'drifter' END AS behaviour FROM en)"""
_FLAGS = ["under-voltage now", "arm frequency capped now", "throttled now", "soft temperature limit now"]
_LATER = ["under-voltage occurred", "arm frequency capping occurred", "throttling occurred", "soft temperature limit occurred"]
_PARTS = """p AS (SELECT p_partkey, p_partkey AS k, replace(p_name, ' ', '_') AS nm, '20' || lpad((p_partkey % 30)::VARCHAR, 2, '0') || '-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') || 'T' || lpad((p_partkey % 24)::VARCHAR, 2, '0') || ':05:09' AS stamp FROM part),
s AS (SELECT *, CASE k % 4 WHEN 0 THEN 'a/_/' WHEN 1 THEN 'b/' WHEN 2 THEN 'c/_/' ELSE 'd/' END || nm || '/x' || k AS safe FROM p)"""

QUERIES = {
    "rows_frame_probe": Query(rows_frame_probe, f"WITH {FRAMES} SELECT image_id, split, source, frame_label FROM frames WHERE frame_label IN (0, 1)"),
    "rows_patch_probe": Query(rows_patch_probe, f"WITH {FRAMES} SELECT image_id, frame_label FROM frames WHERE split = 'test' AND (mask_path <> '' OR boxed OR frame_label = 0)"),
    "rows_probe_hook": Query(rows_probe_hook, f"WITH {FRAMES} SELECT image_id, split FROM frames WHERE frame_label <> -1 OR boxed OR mask_path <> ''"),
    "rows_training_pool": Query(rows_training_pool, f"WITH {FRAMES} SELECT image_id, round(CASE WHEN weight > 0 THEN weight ELSE 1e-6 END, 6) AS weight FROM frames WHERE split = 'train' AND ok AND source <> 'src0'"),
    "rows_parity": Query(rows_parity, f"WITH {FRAMES} SELECT image_id, frame_label FROM frames WHERE split = 'test' AND (frame_label <> -1 OR boxed)"),
    "rows_sprites": Query(
        rows_sprites,
        f"""WITH {FRAMES} SELECT image_id, concept, CASE concept WHEN 'c0' THEN 'fish' WHEN 'c1' THEN 'squid' WHEN 'c2' THEN 'medusa' ELSE 'shrimp' END AS taxon FROM frames
        WHERE split = 'train' AND source <> 'src3' AND boxed AND vec_id % 3 > 0 AND concept IN ('c0', 'c1', 'c2', 'c4') AND least((x + 0.3::DOUBLE - x) * 100, (y + 0.2::DOUBLE - y) * 80) >= 15""",
    ),
    "filter_detected": Query(
        filter_detected,
        """WITH e AS (SELECT vec_id, 1 / (1 + exp(-(embedding[1]::DOUBLE * 8))) AS p, 1 / (1 + exp(-(embedding[2]::DOUBLE * 8))) AS peak, vec_id % 4 > 0 AS found, embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y, abs(embedding[5]::DOUBLE) AS s FROM embeddings)
        SELECT vec_id, (p >= 0.6 OR peak >= 0.6) AND found AS detected, found AND p >= 0.5 AND abs(x + 0.5 - 0.5) < 0.2 AND abs(y + 0.5 - 0.5) < 0.2 AND s >= 0.02 AS framed, p >= 0.5 AND s * 40 <= 3 AND abs(x) < 0.2 AND abs(y) < 0.2 AS good FROM e""",
    ),
    "unreadable": Query(unreadable, "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'unreadable' END AS removed_reason FROM documents"),
    "bands_prior": Query(
        bands_prior,
        f"""WITH {TELEMETRY}, b AS (SELECT DISTINCT k % 24 + 0.5::DOUBLE AS hour, floor(depth / 10) * 10 + 5.0::DOUBLE AS band FROM telemetry)
        SELECT hour, band, {_CROSS('hour')} AS crossing, round({_PRIOR('hour', 'band')}, 6) AS prior, band BETWEEN 25 AND 125 AS reachable FROM b""",
    ),
    "bands_best": Query(
        bands_best,
        f"""WITH {TELEMETRY}, b AS (SELECT vehicle, floor(depth / 10) * 10 + 5.0::DOUBLE AS band, count(*) FILTER (found) AS events, round(sum(dt), 4) AS exposure FROM timed GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY band BETWEEN 25 AND 125 DESC, (events + 0.05::DOUBLE / 60 * 60 * {_PRIOR('1.5::DOUBLE', 'band')}) / (exposure + 60) DESC, band) AS rn FROM b)
        SELECT vehicle, band FROM r WHERE rn = 1""",
    ),
    "schedules": Query(
        schedules,
        """WITH s AS (SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (event_id - 400) / 8600.0::DOUBLE)) AS u, least(1.0::DOUBLE, event_id / 9000.0::DOUBLE) AS v FROM events)
        SELECT event_id, round(CASE WHEN event_id < 400 THEN 2e-4 + (1e-3 - 2e-4) * event_id / 400.0::DOUBLE ELSE 1e-6 + (1e-3 - 1e-6) * 0.5::DOUBLE * (1 + cos(pi() * u)) END, 10) AS lr,
        round(0.4::DOUBLE + (0.04::DOUBLE - 0.4::DOUBLE) * 0.5::DOUBLE * (1 + cos(pi() * v)), 8) AS decay, round(0.996::DOUBLE + (1.0::DOUBLE - 0.996::DOUBLE) * v, 8) AS momentum FROM s""",
    ),
    "leave_and_behave": Query(leave_and_behave, f"WITH {_LINES} SELECT l_orderkey, reason, ended, behaviour, round(30 * ln(1 / (30 * (rate + 0.001::DOUBLE))), 5) AS leave_s FROM be"),
    "throttle_and_storage": Query(
        throttle_and_storage,
        f"""WITH {TELEMETRY}, w AS (SELECT event_id, depth, xor(k, (k % 16) << 16) AS w FROM telemetry)
        SELECT event_id, array_to_string(list_filter([{', '.join(f"CASE WHEN w & {1 << b} <> 0 THEN '{n}' END" for b, n in [*enumerate(_FLAGS), *[(16 + i, n) for i, n in enumerate(_LATER)]])}], lambda x: x IS NOT NULL), '; ') AS flags,
        round(depth * 1e9 * 8 / 8e6 / 3600, 5) AS hours FROM w""",
    ),
    "taxa": Query(taxa, f"WITH n AS (SELECT p_partkey, ['Animalia', ({_TAX!r})[p_partkey % 11 + 1], ({_TAX!r})[(p_partkey // 11) % 11 + 1]] AS a FROM part) SELECT p_partkey, {_GROUPS} AS taxon FROM n"),
    "names_and_days": Query(
        names_and_days,
        f"""WITH {_PARTS} SELECT p_partkey, safe, array_to_string(string_split(safe, '/')[1:2], '/') AS clip, CASE WHEN k % 4 = 3 THEN 'h' || (k % 7) ELSE 'h' || (k % 7) END AS habitat, CASE WHEN k % 9 > 0 THEN substr(stamp, 1, 10) ELSE '' END AS day,
        CASE WHEN k % 5 <= 2 THEN replace(stamp, 'T', ' ') END AS taken, CASE k % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'val' END AS split FROM s""",
    ),
    "site_groups": Query(
        site_groups,
        """SELECT page_id, 'site:' || CASE page_id % 3 WHEN 0 THEN CASE WHEN page_id % 3 = 0 THEN 'EX' ELSE '' END WHEN 1 THEN 'dive' ELSE
          CASE WHEN page_id % 5 > 0 THEN 'u' || (page_id % 3) ELSE 'na' END || ':' || CASE WHEN page_id % 4 > 0 THEN '2021-03-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') ELSE '' END || ':' ||
          CASE WHEN page_id % 7 > 0 THEN printf('%.1f', page_id % 90 + 0.25::DOUBLE) || ',' || printf('%.1f', -(page_id % 180 + 0.75::DOUBLE)) ELSE 'na,na' END END AS grp FROM pages""",
    ),
    "blob_choice": Query(
        blob_choice,
        """WITH b AS (SELECT label, vec_id, sqrt((embedding[1]::DOUBLE + 0.5 - 0.6::DOUBLE) ** 2 + (embedding[2]::DOUBLE + 0.5 - 0.6::DOUBLE) ** 2) AS off, abs(embedding[3]::DOUBLE) * 10 AS mass FROM embeddings),
        n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY off <= 0.05 DESC, CASE WHEN off <= 0.05 THEN off ELSE 0 END, CASE WHEN off <= 0.05 THEN 0 ELSE mass END DESC, vec_id) AS a, row_number() OVER (PARTITION BY label ORDER BY mass DESC, vec_id) AS h FROM b)
        SELECT x.label, x.vec_id AS near_id, y.vec_id AS heavy_id FROM n x JOIN n y ON x.label = y.label WHERE x.a = 1 AND y.h = 1""",
    ),
    "results_costs": Query(
        results_costs,
        """WITH r AS (SELECT p_type, p_size, round(sum(p_retailprice), 2) AS value FROM part GROUP BY 1, 2), c AS (SELECT p_type || '_' || p_size AS model, count(*) AS fps FROM part WHERE p_size > 20 GROUP BY 1)
        SELECT p_type, p_size, value, fps FROM r LEFT JOIN c ON model = p_type || '_' || p_size""",
    ),
    "results_against": Query(
        results_against,
        """WITH r AS (SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2)
        SELECT r.o_orderpriority, r.o_orderstatus, r.value, round(r.value - b.value, 4) AS delta FROM r LEFT JOIN r b ON b.o_orderpriority = '1-URGENT' AND b.o_orderstatus = r.o_orderstatus""",
    ),
    "thresholds_global": Query(
        thresholds_global,
        f"""WITH {BUCKETED}, q AS (SELECT quantile_cont(lum_mean, [0.15, 0.45]) AS l, quantile_cont(clarity, [0.3, 0.7]) AS c FROM bucketed)
        SELECT unnest(['dark', 'dim', 'murky', 'clear']) AS name, round(unnest([l[1], l[2], c[1], c[2]]), 6) AS value FROM q""",
    ),
    "encounter_reasons": Query(
        encounter_reasons,
        f"""WITH {_LINES}, j AS (SELECT ended, behaviour, o_totalprice / 1000 AS e, o_totalprice / 3000 AS g FROM be JOIN orders ON l_orderkey = o_orderkey)
        SELECT 'ended' AS "by", ended AS "key", count(*) AS encounters, round(median(e), 4) AS median_engaged_s, round(median(g), 4) AS median_good_s FROM j GROUP BY 2
        UNION ALL SELECT 'behaviour', behaviour, count(*), round(median(e), 4), round(median(g), 4) FROM j GROUP BY 2""",
    ),
    "value_per_hour": Query(
        value_per_hour,
        f"""WITH {TELEMETRY}, a AS (SELECT *, coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, lead(t) OVER (ORDER BY t, event_id) - t)), 0) AS d FROM telemetry)
        SELECT count(*) AS frames, round((max(t) - min(t)) / 60, 4) AS minutes, round(coalesce(sum(d) FILTER (state = 'SAFE'), 0) / 60, 4) AS outside_minutes,
        round((max(t) - min(t)) / 3600 - coalesce(sum(d) FILTER (state = 'SAFE'), 0) / 3600, 6) AS mission_hours, count(*) FILTER (state = 'SEARCH' AND k < 10) AS missions FROM a""",
    ),
    "spread_of": Query(spread_of, f"WITH {TELEMETRY} " + " UNION ALL ".join(f"SELECT '{c}' AS measure, round(quantile_cont({c}, 0.05), 6) AS p5, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.95), 6) AS p95 FROM telemetry" for c in ("depth", "temp"))),
    "frames_in_order": Query(frames_in_order, f"WITH {TELEMETRY} SELECT event_id, row_number() OVER (ORDER BY t, event_id) - 1 AS place FROM telemetry"),
    "tail_memory": Query(tail_memory, f"WITH {TELEMETRY} SELECT event_id, vehicle FROM (SELECT event_id, vehicle, row_number() OVER (PARTITION BY vehicle ORDER BY t DESC, event_id DESC) AS n FROM telemetry) WHERE n <= 64"),
    "heat_max_auc": Query(
        heat_max_auc,
        """WITH h AS (SELECT vec_id, label % 2 AS y, 1 / (1 + exp(-list_max(embedding::DOUBLE[]) * 8)) AS top FROM embeddings),
        r AS (SELECT y, (rank() OVER (ORDER BY top) + count(*) OVER (PARTITION BY top) / 2.0::DOUBLE - 0.5::DOUBLE) AS rk FROM h)
        SELECT count(*) AS n, count(*) FILTER (y = 1) AS n_pos, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r""",
    ),
    "label_stats": Query(
        label_stats,
        f"""WITH {FRAMES} SELECT source, split, count(*) AS images, count(*) FILTER (frame_label = 1) AS positive, count(*) FILTER (frame_label = 0) AS negative, count(*) FILTER (frame_label = -1) AS unknown,
        sum(boxed::INTEGER)::BIGINT AS boxes, count(*) FILTER (mask_path <> '') AS masks FROM frames GROUP BY 1, 2""",
    ),
    "layer_and_light": Query(
        layer_and_light,
        f"""WITH {TELEMETRY}, h AS (SELECT event_id, k % 24 + depth / 1000 AS hour FROM telemetry), u AS (SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(hour - 6.5::DOUBLE, 18.5::DOUBLE - hour) / 1.5::DOUBLE + 0.5)) AS u, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (least(hour - 6.5::DOUBLE, 18.5::DOUBLE - hour) + 1) / 2)) AS d FROM h)
        SELECT event_id, round(70 + 430 * u * u * (3 - 2 * u), 4) AS layer, round(-6 * (1 - d), 6) AS light FROM u""",
    ),
    "dedup_verified": Query(
        dedup_verified,
        f"""WITH RECURSIVE d AS (SELECT doc_id, n_chars, lang, {_NEAR} AS h FROM documents), m AS (SELECT h, min(doc_id) AS id FROM d GROUP BY 1), p AS (SELECT m.id, m.h, n_chars, lang FROM m JOIN d ON d.doc_id = m.id),
        e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND a.lang = b.lang AND abs(a.n_chars - b.n_chars) <= 10 AND bit_count(xor(a.h, b.h)) <= 6 UNION ALL SELECT id, doc_id FROM m JOIN d USING (h) WHERE id <> doc_id),
        s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(node, part) USING KEY (node) AS (SELECT doc_id, doc_id FROM d UNION (SELECT u.node, min(v.part) FROM recurring.r u JOIN s ON s.a = u.node JOIN r v ON v.node = s.b WHERE v.part < u.part GROUP BY 1))
        SELECT node AS doc_id, part AS dup_cluster FROM r""",
    ),
    "mask_cells": Query(mask_cells, None),
    "robustness_sweep": Query(robustness_sweep, None),
}
