import random

import pytest

from loomcast.llm import overlap, rlz

from . import brute


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(r.choice([2, 40, 3000]))] + ["é", "日本"]
    say = lambda n: r.choices(vocabulary, k=n)
    passages = [say(r.randrange(10, 60)) for _ in range(5)]
    rows = []
    for i in range(120):
        w = say(r.randrange(40))
        for _ in range(r.randrange(3)):
            w += r.choice(passages) + say(r.randrange(8))
        if w and r.random() < 0.3:
            w[r.randrange(len(w))] = "edit"
        rows.append((r.choice([i, i, i, i // 2, -i, None]), r.choice([" ", "\n", "\t ", "  "]).join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n "), (0, "a " * 400), (1003, "a " * 300), (1004, "x" * 3000)]


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_the_definition(spark, seed, monkeypatch):
    monkeypatch.setattr(overlap, "CHUNK_BYTES", 4000)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], "doc_id long, text string, n_words int, chunk string")
    got = sorted((str(r.doc_id), r.n_words, r.kept_text) for r in rlz.deduplicate(docs).collect())
    assert got == sorted((str(i), n, kept) for i, n, kept in brute.rlz(rows, rlz.WIDTH))


def test_factors_point_at_their_source(spark):
    rows = [(i, t) for i, t in corpus(7) if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    text = {i: brute.words(t) for i, t in rows}
    got = rlz.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any(r.factors for r in got)
    for r in got:
        cover = set()
        for f in r.factors:
            assert f.source_id < r.doc_id and f.n_words >= rlz.WIDTH
            assert text[r.doc_id][f.word : f.word + f.n_words] == text[f.source_id][f.source_word : f.source_word + f.n_words]
            cover |= set(range(f.word, f.word + f.n_words))
        assert len(cover) == r.n_removed


def test_empty(spark):
    assert rlz.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []
