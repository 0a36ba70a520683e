import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomcast.llm import kernels as K
from loomcast.llm import langid

A = ["the cat and the dog went there with them", "then they that other thing"]
B = ["der Hund und die Katze gehen nicht über", "sich auch für mich"]


@pytest.fixture(scope="module")
def model():
    return langid.fit([(f"{x} {y}\n{y}", "en") for x, y in itertools.product(A, A)] * 3 + [(f"{x} {y}\n{y}", "de") for x, y in itertools.product(B, B)] * 3, rounds=40)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    scores, transitions = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    start, size = np.array([5, 0, 4]), np.array([4, 4, 1])
    got = langid.marginals(scores, start, size, transitions)
    for s, n in zip(start, size):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[s + i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(got[s : s + n], want / want.sum(axis=1, keepdims=True))


def test_expected_pairs_equal_enumeration():
    rng = np.random.default_rng(4)
    scores, transitions = rng.normal(size=(2, 4, 2)), rng.normal(size=(2, 2))
    want = np.zeros((2, 2))
    for s in scores:
        paths = list(itertools.product(range(2), repeat=4))
        p = np.array([np.exp(sum(s[i, y] for i, y in enumerate(q)) + sum(transitions[a, b] for a, b in zip(q, q[1:]))) for q in paths])
        for q, w in zip(paths, p / p.sum()):
            for a, b in zip(q, q[1:]):
                want[a, b] += w
    assert np.allclose(langid.expected_pairs(scores, transitions), want)


def test_predictions(model):
    rows = ["The cat went there", "die Katze und der Hund", None, "", "123 -- 456", "…", "THE DOG", "the dog and them\nder Hund und mich und die Katze", "über", "the " * 700]
    got = langid.predict(pa.array(rows), model)
    assert got["lang_pred"] == ["en", "de", "und", "und", "und", "und", "en", "de", "de", "en"]
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all() and got["score"][2] == 0
    assert got["n_switches"][7] >= 1


def test_words_do_not_depend_on_the_batch(model):
    rows = [*A, *B, "the\nund"]
    together = langid.predict(pa.array(rows), model)["score"]
    assert np.allclose(together, [langid.predict(pa.array([x]), model)["score"][0] for x in rows])


def test_query(spark):
    rows = [(i, (A if i % 2 else B)[i % 3 % 2], "en" if i % 2 else "de", 1) for i in range(60)] + [(None, "the cat", "de", 1), (99, None, "en", 2), (100, "", None, 3), (100, "die Katze", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out int")
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
    truth = {i: lang for i, _, lang, _ in rows if i is not None and i < 60}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth)
    kept = langid.keep_identified(docs, model)
    assert kept.schema == docs.schema and kept.count() == len(rows) - 2
    none = langid.train(docs.limit(0))
    assert none.empty and {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_features_are_of_the_word_alone():
    data = K.fold(np.frombuffer("Über uber".encode(), np.uint8))
    numbers, sizes = langid.features(data, np.array([0, 6]), np.array([5, 10]), np.zeros(0, K.U64))
    again, _ = langid.features(data[6:], np.array([0]), np.array([4]), np.zeros(0, K.U64))
    assert sorted(numbers[sizes[0] :]) == sorted(again)


def plainly(text, model):
    """The language of a text, word by word, from the model's arrays alone."""
    import re

    from loomcast.llm import kernels as K

    k, total, weight = len(model.langs), np.zeros(len(model.langs)), 0
    for line in (text or "").split("\n"):
        words = [w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", K.fold(np.frombuffer(line.encode(), np.uint8)).tobytes()) if w]
        if not words:
            continue
        scores = []
        for w in words:
            data = np.frombuffer(w, np.uint8)
            numbers, counts = langid.features(data, np.array([0]), np.array([len(w)]), model.lexicon)
            scores.append(model.weights[numbers].astype(float).sum(0) / np.sqrt(counts[0]))
        alpha = [np.array(scores[0])]
        for s in scores[1:]:
            alpha.append(s + np.array([np.logaddexp.reduce(alpha[-1] + model.transitions[:, j]) for j in range(k)]))
        beta = [np.zeros(k)]
        for s in reversed(scores[1:]):
            beta.append(np.array([np.logaddexp.reduce(model.transitions[i] + s + beta[-1]) for i in range(k)]))
        for w, a, b in zip(words, alpha, reversed(beta)):
            if any(c >= 128 or chr(c).isalpha() for c in w):
                p = np.exp(a + b - np.logaddexp.reduce(a + b))
                total, weight = total + p, weight + 1
    if not weight:
        return "und", 0.0
    return model.langs[int(np.argmax(total))], float(total.max() / weight)


def test_predictions_equal_a_plain_version(monkeypatch):
    import random

    monkeypatch.setattr(langid, "PART", 7)
    r = random.Random(3)
    vocabulary = {"aa": "die der und haus ich straße über".split(), "bb": "the and house of under when".split(), "cc": "la maison été où les rue".split()}
    say = lambda lang, n: " ".join(r.choices(vocabulary[lang], k=n))
    model = langid.fit([(say(lang, 120), lang) for lang in vocabulary for _ in range(8)], rounds=15)
    texts = [say(lang, n) for lang in vocabulary for n in (1, 3, 40)] + [f"{say('aa', 9)}, {say('bb', 9)}!\n{say('cc', 30)}", "", None, "123 -", "x\n\n9 y", "Straße 12 ÜBER", say("aa", 60) + " " + say("bb", 60)]
    got = langid.predict(pa.array(texts, pa.string()), model)
    for text, lang, score in zip(texts, got["lang_pred"], got["score"]):
        want = plainly(text, model)
        assert (lang, round(float(score), 6)) == (want[0], round(want[1], 6)), text
