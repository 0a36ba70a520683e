import random

import numpy as np
import pyarrow as pa
import pytest

from loomcast.llm import kernels as K
from loomcast.llm import nearduplicates as N

from . import brute


def corpus(seed, n=150):
    r = random.Random(seed)
    say = lambda k: r.choices([f"W{i}" for i in range(900)], k=k)
    bases = [say(r.choice([3, 7, 20, 60, 150])) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases)) if r.random() < 0.8 else say(r.randrange(30))
        for _ in range(r.randrange(5)):
            if w:
                w[r.randrange(len(w))] = r.choice(["w1", "edit"])
        if r.random() < 0.3:
            w += say(r.randrange(12))
        rows.append((r.choice([i + 3, i + 3, i + 3, None]), r.choice([" ", "\n", "  "]).join(w).title()))
    return rows + [(1000, None), (1001, ""), (1002, " "), (1003, "One word"), (1004, "one WORD"), (1005, "É é"), (1006, "é é"), (1007, "a " * 300), (1008, "a " * 200)]


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "SALT", 3)
    monkeypatch.setattr(N, "COLUMNS", 16)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_shingles int, digest string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in N.classify(docs).collect())
    assert got == sorted((str(i), n, str(c), i == c) for i, n, c in brute.near(rows))


def test_keep_one(spark):
    rows = corpus(5, 60)
    rows += [rows[3], (None, None), (None, None), rows[3]]
    docs = spark.createDataFrame([(i, t, "r", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, ROW string, text_key int")
    out = N.keep_one(docs)
    assert out.schema == docs.schema
    kept = [(r.doc_id, r.text) for r in out.collect()]
    component = [c for _, _, c in brute.near(rows)]
    sets = [bool(brute.shingles(t)) for _, t in rows]
    assert sorted(map(str, [x for x in kept if not brute.shingles(x[1])])) == sorted(map(str, [x for x, s in zip(rows, sets) if not s]))
    texts = {t: c for (_, t), c, s in zip(rows, component, sets) if s and c is not None}
    named = [texts[t] for i, t in kept if t in texts]
    assert len(named) == len(set(named)) and set(named) == set(texts.values())


def test_chain_joins_across_pivots(spark):
    # neighbours are similar, the ends are not, and ids fall along the chain
    base = [f"w{i}" for i in range(60)]
    rows = [(100 - k, " ".join(base[3 * k : 3 * k + 40])) for k in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.classify(docs).collect()}
    assert got == {i: c for i, _, c in brute.near(rows)}


def test_closure_finds_what_pivots_miss(spark, monkeypatch):
    # with one key for all, all but the links to the oldest node come from the closure
    monkeypatch.setattr(N, "band_keys", lambda registers: np.zeros((len(registers), N.REPEATS), np.int64))
    rows = corpus(11, 60)
    keyed = N._keyed
    monkeypatch.setattr(N, "_keyed", lambda batches: (pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int64)), b.column("node")], names=["key", "node"]) for b in batches))
    assert keyed is not N._keyed
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in N.classify(docs).collect())
    assert got == sorted((str(i), str(c)) for i, _, c in brute.near(rows))


def test_estimates():
    rng = np.random.default_rng(1)
    near_kept = far_kept = bands = 0
    for _ in range(150):
        u = K.mix(rng.integers(0, 1 << 62, 160, dtype=np.uint64))
        a, b = np.sort(u[:140]), np.sort(u[20:])  # similarity 0.75
        c = np.sort(np.concatenate([u[:50], K.mix(rng.integers(0, 1 << 62, 90, dtype=np.uint64))]))
        s = N.sketches(np.concatenate([a, b, c]), np.array([0, 140, 280, 420]))
        near_kept += bool(N.likely(s[0][None], s[1][None])[0])
        far_kept += bool(N.likely(s[0][None], s[2][None])[0])
        keys = N.band_keys(s)
        bands += (keys[0] == keys[1]).sum()
    assert near_kept == 150 and far_kept == 0
    assert 0.25 < bands / 150 / N.REPEATS < 0.4


def test_codes():
    top = (1 << 61) | (0b1100000001 << 51)
    got = N.codes(np.array([top, top >> 5, 0, K._MASK], dtype=np.uint64))
    assert got.tolist() == [0b1100000001 + 1, (5 << 10) + 0b1100000001 + 1, (53 << 10) + 1, 0]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 6), (6, 7), (7, 5), (4, 20), (21, 20)]
    got = {r.node: r.component for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4, 20, 21), 1), **dict.fromkeys((8, 9), 8), **dict.fromkeys((5, 6, 7), 5)}


def test_empty(spark):
    assert N.classify(spark.createDataFrame([], "doc_id long, text string")).collect() == []
