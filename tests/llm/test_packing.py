import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcast.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [None, "", " ", "The, the. THE... don't DON'T we'll a≠b ≠", "KK J̌ ǰ É éx É", "<|endoftext|> x<|ENDOFTEXT|>", "a<|endoftext|>b end|x", "x" * 30000, "a b\tc\r\nd", "été, ÉTÉ! ''s 's'S 12,34.5", "ﬁ ǅ İ ß"]


def ids_of(tok, text):
    return tok.tok.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tok():
    return packing.WordTokenizer(PATH)


def test_ids_equal_the_tokenizer(tok):
    for batch in (HARD, [x for x in HARD if x is None or "<|" not in x]):
        flat, ends = tok.ids(pa.array(batch, pa.string()))
        starts = np.concatenate([[0], ends[:-1]])
        assert [flat[a:b].tolist() for a, b in zip(starts, ends)] == [ids_of(tok, x) for x in batch]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB,.='é̸́ \n9<|>-", max_size=12), max_size=4))
def test_ids_equal_the_tokenizer_on_any_text(batch):
    tok = packing.word_tokenizer(PATH)
    flat, ends = tok.ids(pa.array(batch, pa.string()))
    assert flat.tolist() == [i for x in batch for i in ids_of(tok, x)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=30))
def test_best_fit_and_bound(lengths):
    lengths = np.array(lengths, dtype=np.int64)
    bins, offsets, fills = packing.best_fit_decreasing(lengths, 20)
    bound = packing.lower_bound(np.bincount(lengths, minlength=21), 20)
    assert bound <= len(fills) <= bound * 1.25 + 1
    for b in range(len(fills)):
        mine = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist()))
        assert [o for o, _ in mine] == np.cumsum([0, *[n for _, n in mine]])[:-1].tolist()
        assert fills[b] == sum(n for _, n in mine) <= 20


def test_bound_beats_volume():
    # three items of 11 fill no bin of 20 in pairs
    assert packing.lower_bound(np.bincount([11, 11, 11], minlength=21), 20) == 3


def test_pack_documents(spark, tok):
    rows = [(i, x) for i, x in enumerate(HARD)] + [(None, "a null id"), (3, "again"), (100, "word " * 9000)] + [(200 + i, "ab " * (i * 37 % 900)) for i in range(120)]
    docs = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, piece int, sequence_id int")
    got = packing.pack_documents(docs, PATH).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    want = {}
    for i, x in rows:
        full = np.array([*ids_of(tok, x), 0], dtype="<u4")
        for k in range(0, len(full), 2048):
            want.setdefault(i, []).append((k // 2048, k, len(full[k : k + 2048]), zlib.crc32(full[k : k + 2048].tobytes())))
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in x) for i, x in by_doc.items()} == {i: sorted(x) for i, x in want.items()}
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in fill.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(fill) <= -(-total // 2048) + 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_bounds_are_told(spark):
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate([12, 11, 11, 9, 8, 3, 3, 20, 20])], packing.PIECES)
    got = packing.pack(pieces, 20).collect()
    short = [r for r in got if r.length < 20]
    assert {r.group_bound for r in short} == {3} and {r.group_bins for r in short} == {len({r.sequence_id for r in short})} == {3}
    assert [(r.group_bins, r.group_bound) for r in got if r.length == 20] == [(1, 1)] * 2
    assert len({r.sequence_id for r in got}) == 5


def test_many_groups_lose_little(spark):
    lengths = np.random.default_rng(5).integers(1, 2047, 6000)
    pieces = spark.createDataFrame([(int(i), 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)
    bound = packing.lower_bound(np.bincount(lengths, minlength=2049), 2048)
    for groups in (1, 5, 40):
        got = packing.pack(pieces, 2048, groups).collect()
        assert sorted(r.doc_id for r in got) == list(range(6000))
        assert len({r.sequence_id for r in got}) <= bound * 1.05


def test_settings_that_join_words_are_refused():
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = "/tmp/loomcast-joins.json"
    tok = Tokenizer(models.BPE(vocab={"a": 0}, merges=[]))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.save(path)
    with pytest.raises(ValueError):
        packing.WordTokenizer(path)
