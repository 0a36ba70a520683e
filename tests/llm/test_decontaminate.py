import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcast.llm import decontaminate as D


def words(text):
    return re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", (text or "").lower())


def leaks(text, item):
    """By definition: every pair of windows, compared place by place."""
    a, b = words(text), words(item)
    size = min(len(b), D.WINDOW)
    allowed = D.ALLOWED if size == D.WINDOW else 1 if size >= 6 else 0
    cover = set()
    for i in range(len(a) - size + 1 if size else 0):
        for j in range(len(b) - size + 1):
            if sum(x != y for x, y in zip(a[i : i + size], b[j : j + size])) <= allowed:
                cover |= set(range(i, i + size))
    return cover


def found(texts, items):
    block = D.index(__import__("numpy").arange(len(items)), pa.array(items, pa.string()))
    w = D.tokens(pa.array(texts, pa.string()))
    start, size, item = D.leaks(D.K.word_hashes(w), w.first, block)
    out = {}
    for s, n, i in zip(start.tolist(), size.tolist(), item.tolist()):
        d = int(w.first.searchsorted(s, side="right") - 1)
        out.setdefault((d, i), set()).update(range(s - w.first[d], s - w.first[d] + n))
    return out


def want(texts, items):
    return {(d, i): c for d, t in enumerate(texts) for i, b in enumerate(items) if (c := leaks(t, b))}


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def test_every_two_substitutions_are_found():
    base = ITEM.split()[:13]
    for i in range(13):
        for j in range(i):
            text = list(base)
            text[i], text[j] = "X", "Y"
            assert found(["a b " + " ".join(text)], [ITEM]), (i, j)
    assert not found(["q " + " ".join(base[:10]) + " x y z"], [ITEM])


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9))
def test_equal_to_the_definition(seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "Ü", "d", "e", "f", "g"][: r.choice([2, 5, 7])]
    items = [" ".join(r.choices(vocabulary, k=r.choice([0, 1, 3, 5, 6, 9, 12, 13, 20]))) for _ in range(3)]
    texts = []
    for _ in range(4):
        t = r.choices(vocabulary, k=r.randrange(25)) + r.choice(items).split() + r.choices(vocabulary, k=3)
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = "z"
        texts.append(", ".join(t))
    assert found(texts, items) == want(texts, items)


def test_query(spark):
    docs = spark.createDataFrame([(None, f"x {ITEM.upper()}!", 1), (1, None, 1), (2, "", 1), (2, "clean words only", 1), (3, "w " * 30000 + ITEM, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, 0), (7, ITEM, 0), (8, None, 0), (None, "clean words only", 0)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.n_tokens): r for r in D.scan(docs, items).collect()}
    assert got[None, 16].item_ids == [7] and got[None, 16].spans == [1, 16] and got[None, 16].n_leaked == 15
    assert got[2, 3].contaminated and not got[1, 0].contaminated and not got[2, 0].contaminated
    assert got[3, 30015].spans == [30000, 30015] or got[3, 30015].n_leaked >= 15
    kept = D.decontaminate(docs, items)
    assert kept.schema == docs.schema and sorted(str(r.text) for r in kept.collect()) == ["", "None"]
    assert D.decontaminate(docs, items.limit(0)).count() == 5
    assert D.scan(docs.limit(0), items).collect() == []


def test_blocks_agree(spark):
    items = spark.createDataFrame([(i, f"i{i} " + ITEM + f" t{i}") for i in range(20)], "item_id long, text string")
    shared = D.blocks(items, block_bytes=400)
    assert len(shared) > 1 and sorted(x for b in shared for x in b.value.item_ids.tolist()) == list(range(20))


def test_spans_exactly(spark):
    docs = spark.createDataFrame([(3, "w " * 30000 + ITEM), (4, f"{ITEM} v " + " ".join(ITEM.split()[:13])), (5, "w " * 50)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, "zzz " + ITEM)], "item_id long, text string")
    got = {r.doc_id: (r.spans, r.n_leaked, r.item_ids, r.contaminated) for r in D.scan(docs, items).collect()}
    # the token before the item stands where "zzz" may be substituted
    cover = lambda text, item: sorted(leaks(text, item))
    for r in docs.collect():
        marked = sorted(set(cover(r.text, ITEM)) | set(cover(r.text, "zzz " + ITEM))) if r.doc_id != 3 else list(range(29999, 30015))
        edges = [x for x in marked if x - 1 not in marked], [x + 1 for x in marked if x + 1 not in marked]
        assert got[r.doc_id] == ([x for pair in zip(*edges) for x in pair], len(marked), [7, 8] if marked else [], bool(marked))


def test_passes_over_several_blocks_agree(spark):
    r = random.Random(4)
    say = lambda n: " ".join(r.choices([f"v{i}" for i in range(400)], k=n))
    items = [(i, say(r.choice([5, 9, 30]))) for i in range(30)]
    docs = [(i // 2, f"{say(9)} {r.choice(items)[1]} {r.choice(items)[1]} {say(4)}" if i % 3 else say(20)) for i in range(60)] + [(None, items[0][1]), (None, None), (9, ""), (9, ""), (3, items[2][1]), (3, items[2][1])]
    docs = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, text_key string")
    items = spark.createDataFrame(items, "item_id long, text string")
    say = lambda df: sorted(map(str, df.collect()))
    assert say(D.scan(docs, items)) == say(D.scan(docs, items, block_bytes=300))
    kept = D.decontaminate(docs, items, block_bytes=300)
    assert kept.schema == docs.schema and say(kept) == say(D.decontaminate(docs, items))


def test_a_prompt_that_all_items_share():
    import time
    import tracemalloc

    import numpy as np

    prompt = " ".join(f"p{i}" for i in range(80))
    items = pa.array([f"{prompt} q{i} r{i} s{i}" for i in range(20000)])
    block = D.index(np.arange(20000), items)
    words = D.tokens(pa.array([prompt]))
    tracemalloc.start()
    began = time.perf_counter()
    start, size, window = D.leaking_windows(D.K.word_hashes(words), words.first, block)
    shared = D.Items(block).of(window)
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert start.min() == 0 and (start + size).max() == 80 and shared == list(range(20000))
    assert took < 3 and peak < 100 << 20, (took, peak)
