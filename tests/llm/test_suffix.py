import random

import numpy as np
import pytest

from loomcast.llm import overlap, suffix

from . import brute


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order(seed, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKET", 50)
    r = random.Random(seed)
    block = bytes(r.choices(b"ab", k=70))
    text = np.frombuffer(b"".join(r.choice([block, block[3:], bytes(r.choices(b"abc", k=9)), b"a" * 90]) for _ in range(20)) + b"z" * 60, np.uint8)
    suffixes = np.array(sorted(r.sample(range(len(text) - 60), 400)))
    got = suffix.suffix_order(text, suffixes)
    raw = text.tobytes()
    assert sorted(got.tolist()) == suffixes.tolist()
    cut = [raw[i : i + suffix.WIDTH] for i in got.tolist()]
    assert cut == sorted(cut)
    assert suffix.same_windows(suffix.eight(text), got).tolist() == [a == b for a, b in zip(cut[1:], cut)]


def test_cover():
    assert all(d < suffix.MODULUS for row in suffix.DISTANCE for d in row)


def corpus(seed):
    r = random.Random(seed)
    letters = r.choice(["ab", "abcdefghij klmnop é", "a"])
    say = lambda n: "".join(r.choices(letters, k=n))
    passages = [say(r.randrange(45, 200)) for _ in range(5)]
    rows = []
    for i in range(100):
        t = say(r.randrange(60))
        for _ in range(r.randrange(3)):
            t += r.choice(passages)[r.randrange(8) :] + say(r.randrange(8))
        if t and r.random() < 0.3:
            k = r.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        rows.append((r.choice([i, i, i, i // 2, -i, None]), t))
    return rows + [(1000, None), (1001, ""), (0, "a " * 400), (1003, "a " * 300), (1004, "x" * 3000), (1005, "x" * 49), (1006, "é" * 30)]


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_the_definition(spark, seed, monkeypatch):
    monkeypatch.setattr(overlap, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(suffix, "BUCKET", 300)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 5, "clash") for i, t in rows], "doc_id long, text string, n_bytes int, bucket string")
    got = sorted((str(r.doc_id), r.n_bytes, bytes(r.kept), r.n_spans, sum(s.end - s.start for s in r.spans) == r.n_removed == r.n_bytes - len(r.kept)) for r in suffix.deduplicate(docs).collect())
    assert got == sorted((str(i), n, kept, spans, True) for i, n, kept, spans in brute.substrings(rows, suffix.WIDTH))


def test_copies_with_one_id(spark, monkeypatch):
    monkeypatch.setattr(overlap, "CHUNK_BYTES", 200)
    r = random.Random(5)
    passage = "".join(r.choices("abcdefgh", k=120))
    rows = [(3, passage[:90] + "X" * 40)] + [(5, "Y" * k + passage) for k in range(12)] + [(5, passage)] * 12
    got = sorted((r.doc_id, bytes(r.kept)) for r in suffix.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, kept) for i, _, kept, _ in brute.substrings(rows, suffix.WIDTH))


def test_empty(spark):
    assert suffix.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []
