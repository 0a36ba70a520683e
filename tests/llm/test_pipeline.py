import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from loomcast.llm import decontaminate, pii

from . import brute
from .test_decontaminate import leaks

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    en = "the cat and the dog went over there with them and then they were seen by that other person in town"
    de = "der Hund und die Katze gehen nicht über die Straße und sich auch für mich in der Stadt zu sehen"
    rows = []
    for i in range(60):
        base = (en if i % 2 else de).split()
        cut = i * 7 % len(base)
        body = " ".join([f"{base[(k * (i + 3) + cut) % len(base)]}{'' if k % 3 else f' {chr(97 + i % 26)}{k}n'}" for k in range(40)])
        rows.append((i, body, "en" if i % 2 else "de", "a", len(body)))
    leak = "benchmark question seven asks which of the small rivers in the north flows past nine old stone mills"
    rows += [(100 + i, rows[i][1], rows[i][2], "b", 0) for i in range(9)]  # exact copies
    rows += [(200 + i, rows[i][1] + " and", rows[i][2], "b", 0) for i in range(9)]  # near copies
    rows += [(300, rows[20][1] + " extra words here to differ " * 9 + leak, "en", "c", 0), (301, None, None, None, None), (302, "123 456", None, "c", 1), (303, "the dog wrote to jo@mail8.example.com and then they went there by 42.144.35.254 in town", "en", "c", 1), (303, "the dog wrote to jo@mail8.example.com and then they went there by 42.144.35.254 in town", "en", "c", 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, leak


def test_stages(spark, folder):
    at, rows, leak = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    state = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(state, docs.schema), at)
        assert out.schema == docs.schema
        got = sorted(map(tuple, out.collect()), key=str)
        if name == "language":
            want = [r for r in state if r[0] not in (301, 302)]
        elif name == "near_duplicates":
            component = brute.near([r[:2] for r in state])
            want = list({r for r, (i, n, c) in zip(state, component) if i == c})
        elif name == "decontamination":
            want = [r for r in state if not leaks(r[1], leak)]
            assert len(want) == len(state) - 1 and decontaminate.WINDOW == 13
        else:
            s = pii.Surrogates()
            want = [(i, t.replace("jo@mail8.example.com", s.of("email", "jo@mail8.example.com")).replace("42.144.35.254", s.of("ip", "42.144.35.254")), *rest) for i, t, *rest in state]
            assert want != state
        assert got == sorted(want, key=str), name
        state = got


def test_run(spark, folder):
    at, _, _ = folder
    got = corpus_pipeline.run(spark, at).collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and not set(ids) & {100, 108, 200, 208, 300, 301, 302} and {0, 59, 303} <= set(ids)


def test_an_empty_table(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert corpus_pipeline.run(spark, at).collect() == []


def test_the_key_is_the_sessions(spark, folder):
    at, rows, _ = folder
    docs = spark.createDataFrame([r for r in rows if r[0] == 303], COLUMNS)
    public = corpus_pipeline.personal_data(spark, docs, at).first().text
    spark.conf.set(corpus_pipeline.KEY_SETTING, "a secret")
    try:
        own = corpus_pipeline.personal_data(spark, docs, at).first().text
    finally:
        spark.conf.unset(corpus_pipeline.KEY_SETTING)
    assert public != own and "jo@mail8" not in own and own == pii.redact(rows[-1][1], pii.Surrogates(b"a secret"))[0]
