import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcast.llm import kernels as K
from loomcast.llm import langid, nearduplicates, packing, quality, rlz, tokencount
from loomcast.llm.queries import PIECE_VOCABULARY, WORD_TOKENIZER, tokenizer_path


def thue_morse(n):
    """The first 2**n letters and their complement: equal under every polynomial hash modulo 2**64 for n = 11."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


LEFT, RIGHT = thue_morse(11)


def hashes(texts):
    return K.word_hashes(K.split_words(*K.text_buffer(pa.array(texts))))


@pytest.mark.parametrize("n", range(3, 14))
def test_structured_words_differ(n):
    assert len(set(hashes(list(thue_morse(n))).tolist())) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\0é"), min_size=1, max_size=600), max_size=8))
def test_hashes_and_codes_tell_bytes(texts):
    words = K.split_words(*K.text_buffer(pa.array([" ".join(texts)], pa.string())))
    codes, distinct = K.span_codes(words.data, words.start, words.end)
    assert [distinct[i].as_py().decode() for i in codes.tolist()] == texts
    for made in (K.word_hashes(words), K.word_hashes(words, second=True)):
        assert len(set(made.tolist())) == len(set(texts))


@pytest.mark.parametrize("width", range(1, 8))
def test_window_codes(width):
    r = random.Random(width)
    codes, first = np.array(r.choices(range(3), k=200)), np.array([0, 3, 3, 90, 95, 200])
    at, number = K.window_codes(codes, first, width)
    own = [tuple(codes[a : a + width]) for a in at.tolist()]
    assert at.tolist() == K.window_starts(first, width).tolist()
    assert len(set(zip(own, number.tolist()))) == len(set(own)) == len(set(number.tolist()))


def test_operators_tell_structured_words(spark):
    import tokenizers

    rows = [(1, LEFT), (2, RIGHT), (3, f"{LEFT} " + "w " * 12), (4, f"{RIGHT} " + "w " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearduplicates.classify(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.n_removed for r in rlz.deduplicate(docs).collect()} == {0}
    tok = tokenizers.Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER))
    flat, ends = packing.word_tokenizer(tokenizer_path(WORD_TOKENIZER)).ids(pa.array([f"{LEFT} {RIGHT}"]))
    assert flat.tolist() == tok.encode(f"{LEFT} {RIGHT}", add_special_tokens=False).ids
    counter = tokencount.counter(tokenizer_path(PIECE_VOCABULARY))
    both, _ = counter.count_batch(pa.array([f"{LEFT} {RIGHT}"]))
    apart, _ = counter.count_batch(pa.array([LEFT, RIGHT]))
    assert both[0] == apart.sum()
    text = " ".join(f"{x} u v" for x in (LEFT, RIGHT))
    assert quality.measure_batch(pa.array([text]))["n_repeat_words"][0] == 0
    assert quality.measure_batch(pa.array([f"{LEFT}\n{RIGHT}\n{LEFT}"]))["n_dup_lines"][0] == 1


def test_long_lines_are_whole(monkeypatch):
    rng = np.random.default_rng(3)
    scores, transitions = rng.normal(size=(700, 4)), rng.normal(size=(4, 4))
    start, size = np.array([0, 5, 6, 300]), np.array([5, 1, 294, 400])
    monkeypatch.setattr(langid, "PART", 10_000)
    whole = langid.marginals(scores, start, size, transitions)
    for part in (1, 2, 7, 64, 400):
        monkeypatch.setattr(langid, "PART", part)
        assert np.allclose(langid.marginals(scores, start, size, transitions), whole, atol=1e-12)


def test_keys_fall_evenly(spark):
    from pyspark.sql import functions as F

    from loomcast.llm import common

    keys = [0, 1, -1, 42, 1 << 40, -(1 << 62), (1 << 63) - 1]
    want = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(F.hash("k")).collect()]
    assert common.spark_hash(np.array(keys)).tolist() == want
    for n, parts in ((1, 1), (7, 3), (51, 51), (206, 51), (5, 200), (1000, 211)):
        keys = common.even_keys(n, parts)
        assert len(set(keys.tolist())) == n
        rows = spark.createDataFrame([(int(k),) for k in keys], "k long").select(F.pmod(F.hash("k"), F.lit(parts)))
        assert [r[0] for r in rows.collect()] == [i % parts for i in range(n)]


def test_many_chunks(spark, monkeypatch):
    from loomcast.llm import overlap

    monkeypatch.setattr(overlap, "LISTED", 2)
    rows = [(i, " ".join(f"w{(i % 7) * 3 + k}" for k in range(20))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted((r.doc_id, r.n_removed) for r in rlz.deduplicate(docs, sizes=overlap.Sizes(200, 400, 100)).collect())
    monkeypatch.setattr(overlap, "LISTED", 4096)
    assert few == sorted((r.doc_id, r.n_removed) for r in rlz.deduplicate(docs).collect()) and any(n for _, n in few)
