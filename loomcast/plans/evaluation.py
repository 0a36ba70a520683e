"""Queries of evaluation: ranking measures, probes, intervals, parity; and of strings and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import metrics as M
from .base import LICENSE_LINE, Query, table

SCORED = """
scored AS (SELECT l.doc_id, l.quality::INTEGER AS y, l.toxic::INTEGER AS toxic, d.source, d.lang, (d.n_chars % 101) / 100.0::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score of many ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", ((F.col("n_chars") % 101) / 100.0).alias("score"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y"), F.col("toxic").cast("int").alias("toxic")).join(docs, "doc_id")


def metric_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.roc_auc(scored(spark, sf_dir), "y", "score", ["lang"])
    return out.withColumn("auc", F.round("auc", 6))


def metric_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.average_precision(scored(spark, sf_dir), "y", "score", "doc_id", ["lang"])
    return out.withColumn("ap", F.round("ap", 6))


def metric_tpr_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.tpr_at_fpr(scored(spark, sf_dir), "y", "score", 0.05, ["toxic"])
    return out.select("toxic", F.round("threshold", 6).alias("threshold"), F.round("tpr", 6).alias("tpr"))


def metric_best_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.best_iou(scored(spark, sf_dir), "y", "score", ["lang"])
    return out.withColumn("best_iou", F.round("best_iou", 6))


def metric_balanced_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("source").agg(F.round(M.balanced_accuracy(F.col("y") == 1, F.col("score") >= 0.4), 6).alias("balanced"))


def metric_within_group_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.within_group_auc(scored(spark, sf_dir), "y", "score", "source")
    return out.withColumn("mean_auc", F.round("mean_auc", 6))


def agg_grouping_sets_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.metric_blocks(scored(spark, sf_dir), "y", "score", [["lang"], ["source"]])
    return out.withColumn("auc", F.round("auc", 6))


def metric_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bootstrap_auc(scored(spark, sf_dir), ["lang"], "y", "score", reps=1000)


def metric_rankme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.collapse(table(spark, sf_dir, "embeddings"), "embedding", 64)


def metric_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.element_at("embedding", 1).cast("double").alias("s"), "embedding")
    coarse = rows.select("vec_id", F.round("s", 2).alias("s"), F.transform("embedding", lambda x: F.round(x.cast("double"), 2)).alias("embedding"))
    out = M.parity(rows, coarse, "vec_id", "s", "embedding")
    return out.select("n", F.round("correlation", 5).alias("correlation"), F.round("mean_cosine", 5).alias("mean_cosine"), F.round("max_abs_diff", 5).alias("max_abs_diff"))


def logreg_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe of one label against the rest, chosen by its loss on a second part and scored on a third."""
    rows = table(spark, sf_dir, "embeddings").withColumn("part", F.col("vec_id") % 3)
    is_label = F.col("label") == 3
    model, decay = M.select_probe(rows.where("part = 0"), rows.where("part = 1"), "embedding", is_label, [1e-3, 1e-2, 1e-1])
    test = M.score_probe(model, rows.where("part = 2"), "embedding").withColumn("y", is_label.cast("int"))
    return M.roc_auc(test, "y", "p").withColumn("weight_decay", F.lit(decay))


def str_normalize_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that the lines of all documents tell, and a list of other ways to say them."""
    lines = table(spark, sf_dir, "documents").select(F.regexp_extract("text", LICENSE_LINE, 1).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    cases = spark.createDataFrame([(x, 0) for x in LICENSE_CASES if x], "raw string, n long")
    named = lines.unionByName(cases).withColumn("license", C.normalize_license(F.col("raw")))
    return named.select("raw", "n", "license", C.commercial_ok(F.col("license")).alias("commercial"))


#: Strings and the licences they tell.
LICENSE_CASES = {
    "https://creativecommons.org/licenses/by-nc-nd/4.0/": "CC-BY-NC-ND-4.0",
    "http://creativecommons.org/licenses/by/3.0/au/": "CC-BY-3.0-AU",
    "https://creativecommons.org/publicdomain/zero/1.0/": "CC0-1.0",
    "https://creativecommons.org/licenses/by-sa/2.0/": "CC-BY-SA-4.0",
    "CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0",
    "CC-BY": "CC-BY-4.0",
    "cc0": "CC0-1.0",
    "Attribution-NonCommercial 4.0 International": "CC-BY-NC-4.0",
    "Attribution 3.0 Australia": "CC-BY-3.0-AU",
    "CDLA-Permissive-1.0": "CDLA-Permissive-1.0",
    "U.S. Public Domain": "public-domain-us-gov",
    "own": "own",
    "all rights reserved": "unknown",
    "": "unknown",
}


def str_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    name = C.url_basename(url)
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.element_at(F.split(F.regexp_extract(url, r"^[a-z]+://[^/]+/([^?#]*)", 1), "/"), 1).alias("first"))


def str_frame_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.translate("p_name", " ", "_"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_frame_"), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise(F.lit("")), F.lit(".png"))
    return table(spark, sf_dir, "part").select("p_partkey", C.video_id(name).alias("video"), C.stem(name).alias("stem"))


def str_cruise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("ex"), F.lpad(k.cast("string"), 4, "0"), F.lit("_DIVE"), (k % 15).cast("string"), F.lit("_20"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit("0102T03.mp4"))
    return table(spark, sf_dir, "part").select("p_partkey", C.cruise(name).alias("cruise"), C.dive(name).alias("dive"), C.capture_date(name).alias("date"), C.split_from_path(F.concat(F.element_at(F.array(*map(F.lit, ("a/Train/", "b/validation/", "c/testset", "d/"))), (k % 4 + 1).cast("int")), F.lit("x_val"), name)).alias("split"))


def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k INT")["k"]
    return table(spark, sf_dir, "events").groupBy((k % 7).alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


def math_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    r = lambda c, n: F.round(c, 5).alias(n)
    return table(spark, sf_dir, "embeddings").select("vec_id", r(C.wrap180(e(1) * 2000), "heading"), r(C.angular_error(e(1), e(2)), "error"), r(C.hours_apart(e(3) * 50 + 12, F.lit(18.5)), "hours"), r(C.sigmoid(e(4) * 10), "probability"), r(C.footage_value(1 + e(5), F.abs(e(6)) * 100), "value"), r(C.smoothstep(e(7) + 0.5), "smooth"), r(C.terminal_speed(e(8) * 10, 2.0, 3.0), "speed"))


def math_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    box = F.array(F.abs(e(1)) * 100, F.abs(e(2)) * 100, F.abs(e(3)) * 300, F.abs(e(4)) * 300)
    corners = C.xywh_to_corners(box, F.lit(100.0), F.lit(80.0))
    place = C.centroid_and_size(F.array(corners))
    out = table(spark, sf_dir, "embeddings").select("vec_id", F.round(C.clarity_score(F.abs(e(1)), e(2) * 10 - 2, F.abs(e(3)) / 5, F.abs(e(4))), 6).alias("clarity"), corners.alias("c"), place.alias("p"))
    return out.select("vec_id", "clarity", *[F.col("c")[i].alias(f"c{i}") for i in range(4)], F.round(F.sqrt("p.cx"), 5).alias("cx_root"), F.round("p.size", 5).alias("size"))


def str_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


_E = lambda i: f"embedding[{i}]::DOUBLE"
_CORNER = lambda v, n: f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({v}) / {n}.0::DOUBLE)), 6)"
_C = [_CORNER(f"abs({_E(1)}) * 100", 100), _CORNER(f"abs({_E(2)}) * 100", 80), _CORNER(f"abs({_E(1)}) * 100 + abs({_E(3)}) * 300", 100), _CORNER(f"abs({_E(2)}) * 100 + abs({_E(4)}) * 300", 80)]
_UNIT = lambda v, a, b: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, (({v}) - ({a})) / (({b}) - ({a}))::DOUBLE))"
_AUC = """SELECT {by}p + q AS n, p AS n_pos, CASE WHEN p > 0 AND q > 0 THEN round(won / (p * q), 6) ELSE 'nan'::DOUBLE END AS auc FROM (
  SELECT {by}count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS q, sum(CASE WHEN y = 1 THEN below + ties / 2.0::DOUBLE END) AS won FROM (
    SELECT *, coalesce(sum((y <> 1)::INTEGER) OVER (PARTITION BY {part} ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum((y <> 1)::INTEGER) OVER (PARTITION BY {part}, score) AS below,
      sum((y <> 1)::INTEGER) OVER (PARTITION BY {part}, score) AS ties FROM {table}) {group})"""

QUERIES = {
    "metric_roc_auc": Query(metric_roc_auc, f"WITH {SCORED} " + _AUC.format(by="lang, ", part="lang", table="scored", group="GROUP BY lang")),
    "metric_ap": Query(
        metric_ap,
        f"""WITH {SCORED}, r AS (SELECT lang, y, sum(y) OVER w AS tp, row_number() OVER w AS rn FROM scored WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT lang, count(*) FILTER (y = 1) AS n_pos, coalesce(round(avg(tp / rn) FILTER (y = 1), 6), 'nan'::DOUBLE) AS ap FROM r GROUP BY 1""",
    ),
    "metric_tpr_fpr": Query(
        metric_tpr_fpr,
        f"""WITH {SCORED}, n AS (SELECT toxic, score, row_number() OVER (PARTITION BY toxic ORDER BY score DESC) AS rn, count(*) OVER (PARTITION BY toxic) AS c FROM scored WHERE y <> 1),
        t AS (SELECT toxic, score AS threshold FROM n WHERE rn = floor(0.05::DOUBLE * c) + 1)
        SELECT toxic, round(any_value(threshold), 6) AS threshold, round(avg((score > threshold)::INTEGER), 6) AS tpr FROM scored JOIN t USING (toxic) WHERE y = 1 GROUP BY 1""",
    ),
    "metric_best_iou": Query(
        metric_best_iou,
        f"""WITH {SCORED}, t AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in M.IOU_THRESHOLDS)}]) AS threshold),
        i AS (SELECT lang, threshold, count(*) FILTER (score >= threshold AND y = 1) AS a, count(*) FILTER (score >= threshold OR y = 1) AS b FROM scored, t GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN b > 0 THEN a / b ELSE 0 END DESC, threshold) AS rn FROM i)
        SELECT lang, CASE WHEN a > 0 THEN round(a / b, 6) ELSE 0 END AS best_iou, CASE WHEN a > 0 THEN threshold ELSE 0.5 END AS best_threshold FROM r WHERE rn = 1""",
    ),
    "metric_balanced_acc": Query(
        metric_balanced_acc,
        f"""WITH {SCORED} SELECT source, round(0.5::DOUBLE * (count(*) FILTER (y = 1 AND score >= 0.4::DOUBLE) / greatest(1, count(*) FILTER (y = 1)) + count(*) FILTER (y <> 1 AND score < 0.4::DOUBLE) / greatest(1, count(*) FILTER (y <> 1))), 6) AS balanced FROM scored GROUP BY 1""",
    ),
    "metric_within_group_auc": Query(
        metric_within_group_auc,
        f"WITH {SCORED}, a AS (" + _AUC.format(by="source, ", part="source", table="scored", group="GROUP BY source").replace("round(won / (p * q), 6)", "won / (p * q)") + ") SELECT count(*) AS n_groups, round(avg(auc), 6) AS mean_auc FROM a WHERE NOT isnan(auc)",
    ),
    "agg_grouping_sets_metrics": Query(
        agg_grouping_sets_metrics,
        f"""WITH {SCORED}, b AS (SELECT 'all' AS block, '' AS key, y, score FROM scored UNION ALL SELECT 'lang', lang, y, score FROM scored UNION ALL SELECT 'source', source, y, score FROM scored),
        a AS ({_AUC.format(by="block, key, ", part="block, key", table="b", group="GROUP BY block, key")}) SELECT * FROM a WHERE n >= 5 AND NOT isnan(auc)""",
    ),
    "metric_bootstrap_ci": Query(metric_bootstrap_ci, None),
    "metric_rankme": Query(metric_rankme, None),
    "metric_parity": Query(
        metric_parity,
        """WITH r AS (SELECT vec_id, embedding[1]::DOUBLE AS s, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT vec_id, round(s, 2) AS s, list_transform(v, lambda x: round(x, 2)) AS v FROM r)
        SELECT count(*) AS n, round(corr(c.s, r.s), 5) AS correlation, round(avg(list_cosine_similarity(c.v, r.v)), 5) AS mean_cosine, round(max(abs(c.s - r.s)), 5) AS max_abs_diff FROM r JOIN c USING (vec_id)""",
    ),
    "logreg_probe": Query(logreg_probe, None),
    "str_normalize_license": Query(
        str_normalize_license,
        f"""WITH lines AS (SELECT regexp_extract(text, '{LICENSE_LINE}', 1) AS raw, count(*) AS n FROM documents GROUP BY 1),
        named AS (SELECT raw, n, CASE raw WHEN 'CC BY-NC 4.0' THEN 'CC-BY-NC-4.0' WHEN 'CC BY 4.0' THEN 'CC-BY-4.0' WHEN 'CC0' THEN 'CC0-1.0' ELSE 'unknown' END AS license FROM lines
          UNION ALL SELECT raw, 0, license FROM (VALUES {", ".join(f"('{raw}', '{lic}')" for raw, lic in LICENSE_CASES.items() if raw)}) t(raw, license))
        SELECT raw, n, license, license NOT IN ('unknown', 'CC-BY-NC-4.0', 'CC-BY-NC-SA-4.0', 'CC-BY-NC-ND-4.0') AS commercial FROM named""",
    ),
    "str_url_parse": Query(
        str_url_parse,
        r"""SELECT page_id, url_decode(split_part(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), '/', -1)) AS name, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
        split_part(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/', 1) AS "first" FROM pages""",
    ),
    "str_frame_suffix": Query(
        str_frame_suffix,
        r"""WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_partkey % 3 WHEN 0 THEN '_frame_' || p_partkey WHEN 1 THEN '-' || p_size ELSE '' END AS stem FROM part)
        SELECT p_partkey, coalesce(nullif(regexp_replace(stem, '[_\-. ]?(frame|frm|f|img|image)?[_\-. ]?\d{1,7}$', '', 'i'), ''), stem) AS video, stem FROM n""",
    ),
    "str_cruise_names": Query(
        str_cruise_names,
        """SELECT p_partkey, 'EX' || lpad(p_partkey::VARCHAR, 4, '0') AS cruise, 'DIVE' || lpad((p_partkey % 15)::VARCHAR, 2, '0') AS dive, '20' || lpad((p_partkey % 30)::VARCHAR, 2, '0') || '0102' AS date,
        CASE p_partkey % 4 WHEN 0 THEN 'train' ELSE 'val' END AS split FROM part""",
    ),
    "json_payload": Query(json_payload, "SELECT ((props->>'$.k')::INTEGER % 7)::INTEGER AS k, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1"),
    "math_geometry": Query(
        math_geometry,
        f"""SELECT vec_id, round((h + 180) - 360 * floor((h + 180) / 360) - 180, 5) AS heading, round(sqrt(({_E(1)} * 102) ** 2 + ({_E(2)} * 67) ** 2), 5) AS error, round(least(m, 24 - m), 5) AS hours,
        round(1 / (1 + exp(-({_E(4)} * 10))), 5) AS probability, round((1 + {_E(5)}) * (1 - exp(-abs({_E(6)}) * 100 / 30.0::DOUBLE)), 5) AS value, round(u * u * (3 - 2 * u), 5) AS smooth,
        round(sign(f) * (-2 + sqrt(4 + 12 * abs(f))) / 6, 5) AS speed FROM (SELECT *, {_E(1)} * 2000 AS h, abs(d - 24 * floor(d / 24)) AS m, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_E(7)} + 0.5)) AS u, {_E(8)} * 10 AS f
        FROM (SELECT *, {_E(3)} * 50 + 12 - 18.5 AS d FROM embeddings))""",
    ),
    "math_scores": Query(
        math_scores,
        f"""SELECT vec_id, clarity, c0, c1, c2, c3, CASE WHEN area > 0 THEN round(sqrt((c0 + c2) / 2), 5) END AS cx_root, CASE WHEN area > 0 THEN round(sqrt(least(area, 1.0::DOUBLE)), 5) END AS size FROM (
        SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c2 - c0)) * greatest(0.0::DOUBLE, least(1.0::DOUBLE, c3 - c1)) AS area FROM (SELECT vec_id, {', '.join(f'{c} AS c{i}' for i, c in enumerate(_C))},
        round(0.40 * {_UNIT(f'abs({_E(1)})', '0.03::DOUBLE', '0.30::DOUBLE')} + 0.30 * {_UNIT(f'{_E(2)} * 10 - 2', '-4.0::DOUBLE', '-1.0::DOUBLE')} + 0.15 * {_UNIT(f'abs({_E(3)}) / 5', '0.0::DOUBLE', '0.05::DOUBLE')} + 0.15 * {_UNIT(f'abs({_E(4)})', '0.18::DOUBLE', '0.40::DOUBLE')}, 6) AS clarity FROM embeddings))""",
    ),
    "str_checksums": Query(str_checksums, "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents"),
}
