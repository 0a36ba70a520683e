"""The registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, nearduplicates, packing, pii, quality, rlz, secrets, suffix, tokencount
from .common import small_batches

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op4_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_suffix_array_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op6_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"))


def op7_count_only_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_VOCABULARY))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = suffix.deduplicate(table(spark, sf_dir, "documents"))
    return stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearduplicates.classify(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), 2048)


def op1_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = rlz.deduplicate(table(spark, sf_dir, "documents"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("doc_id", "n_tokens", "n_leaked", joined("item_ids"), joined("spans"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_rlz_substring_dedup": op1_rlz_substring_dedup,
        "op2_crf_language_id": op2_crf_language_id,
        "op3_spaced_seed_decontamination": op3_spaced_seed_decontamination,
        "op4_assignment_secrets": op4_assignment_secrets,
        "op5_suffix_array_quality": op5_suffix_array_quality,
        "op6_surrogate_pii": op6_surrogate_pii,
        "op7_count_only_viterbi": op7_count_only_viterbi,
        "op8_suffix_array_dedup": op8_suffix_array_dedup,
        "op9_hyperminhash_near_dedup": op9_hyperminhash_near_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
    }


WORD = r"[^\x20\x09-\x0D]+"

#: The words of each text, one a row, and how many there are.
WORDS = f"""
split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM split)"""


def grams(name: str, width: int) -> str:
    """A table of the words with the sequence of `width` words that begins at each, null at the end."""
    return f"""{name} AS (SELECT *, CASE WHEN i + {width - 1} <= n THEN array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING), ' ') END AS g FROM words)"""


def covered(hit: str, width: int) -> str:
    """Whether a row is within `width` rows that begin at one with `hit`."""
    return f"bool_or({hit}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


def repeats(name: str, width: int) -> str:
    """Words of each text within sequences of `width` words that it has twice."""
    return f"""{grams(f"{name}_grams", width)},
{name}_seen AS (SELECT doc_id, i, coalesce(g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, md5(g)) > 1, FALSE) AS twice FROM {name}_grams),
{name}_in AS (SELECT doc_id, {covered("twice", width)} AS hit FROM {name}_seen),
{name} AS (SELECT doc_id, count(*) FILTER (hit) AS {name} FROM {name}_in GROUP BY doc_id)"""


RLZ_SQL = f"""WITH {WORDS}, {grams("grams", rlz.WIDTH)},
seen AS (SELECT doc_id, i, word, coalesce(g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id, FALSE) AS earlier FROM grams),
marked AS (SELECT doc_id, i, word, {covered("earlier", rlz.WIDTH)} AS gone FROM seen),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS rest FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)"""

QUALITY_SQL = f"""WITH {WORDS}, {repeats("three", 3)}, {repeats("cover", quality.MIN_REPEAT)}, {repeats("long", quality.MAX_REPEAT + 1)},
own AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM words GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
told AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(three, 0) AS n_repeat_words, coalesce(cover, 0) AS repeat_cover, coalesce(long, 0) AS long
  FROM documents LEFT JOIN own USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN three USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * repeat_cover <= {quality.MAX_COVER} * n_words AND long = 0 AS kept, repeat_cover FROM told"""


def _doubled(width: int) -> str:
    """Tables g2, g4, ... of the sequences of so many bytes at each place, up to `width`."""
    out, have, built = [], 1, []
    while 2 * have <= width:
        out.append(f"g{2 * have} AS (SELECT *, g || lead(g, {have}) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM {'b1' if have == 1 else f'b{have}'}), b{2 * have} AS (SELECT doc_id, i, b, h AS g{''.join(f', p{x}' for x in built)}{f', g AS p{have}' if width & have else ''} FROM g{2 * have})")
        built += [have] if width & have else []
        have *= 2
    rest, at = [], have
    for x in sorted(built, reverse=True):
        rest.append(f"lead(p{x}, {at}) OVER (PARTITION BY doc_id ORDER BY i)")
        at += x
    return ",\n".join(out) + f",\nwhole AS (SELECT doc_id, i, b, {' || '.join(['g', *rest])} AS g FROM b{have})"


SUFFIX_SQL = f"""WITH split AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bs FROM documents),
b1 AS (SELECT doc_id, unnest(bs) AS b, unnest(bs) AS g, generate_subscripts(bs, 1) AS i FROM split),
{_doubled(suffix.WIDTH)},
seen AS (SELECT doc_id, i, b, coalesce(g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id, FALSE) AS earlier FROM whole),
marked AS (SELECT doc_id, i, b, {covered("earlier", suffix.WIDTH)} AS gone FROM seen),
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS begins FROM marked),
kept AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS rest FROM edged GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)"""

NEAR_SQL = f"""WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM split), {grams("grams", nearduplicates.SHINGLE)},
sets AS (SELECT DISTINCT doc_id, g FROM grams WHERE g IS NOT NULL UNION SELECT doc_id, array_to_string(ws, ' ') FROM split WHERE len(ws) BETWEEN 1 AND {nearduplicates.SHINGLE - 1}),
sizes AS (SELECT doc_id, count(*) AS s FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {nearduplicates.PERCENT} * (p.s + q.s - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, seen) AS (SELECT x, x FROM both_ways UNION SELECT r.doc_id, e.y FROM reach r JOIN both_ways e ON r.seen = e.x),
least AS (SELECT doc_id, min(seen) AS m FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(s, 0) AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_TOKENS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"

#: Windows that differ at no more places than allowed agree in one of so many parts and one.
LEAKS_SQL = f"""WITH d AS (SELECT doc_id, {_TOKENS} AS ws FROM documents), b AS (SELECT item_id, {_TOKENS} AS ws FROM benchmark),
sizes AS (SELECT DISTINCT least(len(ws), {decontaminate.WINDOW}) AS size, CASE WHEN len(ws) >= {decontaminate.WINDOW} THEN {decontaminate.ALLOWED} WHEN len(ws) >= 6 THEN 1 ELSE 0 END AS allowed FROM b WHERE len(ws) > 0),
iw AS (SELECT item_id, size, allowed, ws[j : j + size - 1] AS g FROM (SELECT item_id, ws, size, allowed, unnest(range(1, len(ws) - size + 2)) AS j FROM b JOIN sizes ON size = least(len(ws), {decontaminate.WINDOW}))),
ik AS (SELECT *, array_to_string(g[size * k // (allowed + 1) + 1 : size * (k + 1) // (allowed + 1)], ' ') AS part FROM (SELECT *, unnest(range(0, allowed + 1)) AS k FROM iw)),
dw AS (SELECT doc_id, size, allowed, i, ws[i : i + size - 1] AS g FROM (SELECT doc_id, ws, size, allowed, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes)),
dk AS (SELECT doc_id, size, allowed, i, g, k, array_to_string(g[size * k // (allowed + 1) + 1 : size * (k + 1) // (allowed + 1)], ' ') AS part FROM (SELECT *, unnest(range(0, allowed + 1)) AS k FROM dw)),
hits AS (SELECT DISTINCT doc_id, i, dk.size AS size, item_id FROM dk JOIN ik ON dk.size = ik.size AND dk.k = ik.k AND dk.part = ik.part
  WHERE len(list_filter(range(1, dk.size + 1), lambda x: dk.g[x] <> ik.g[x])) <= dk.allowed),
cover AS (SELECT DISTINCT doc_id, unnest(range(i - 1, i - 1 + size)) AS pos FROM hits),
runs AS (SELECT doc_id, min(pos) AS a, max(pos) + 1 AS e, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM cover) GROUP BY doc_id, run),
spans AS (SELECT doc_id, sum(n)::BIGINT AS n_leaked, string_agg(a || ',' || e, ',' ORDER BY a) AS spans FROM runs GROUP BY 1),
named AS (SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(ws) AS n_tokens, coalesce(n_leaked, 0) AS n_leaked, coalesce(item_ids, '') AS item_ids, coalesce(spans, '') AS spans, n_leaked IS NOT NULL AS contaminated FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN named USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The queries whose whole result SQL can say; the others are tested against plain versions."""
    return {
        "op1_rlz_substring_dedup": RLZ_SQL,
        "op3_spaced_seed_decontamination": LEAKS_SQL,
        "op5_suffix_array_quality": QUALITY_SQL,
        "op8_suffix_array_dedup": SUFFIX_SQL,
        "op9_hyperminhash_near_dedup": NEAR_SQL,
    }
