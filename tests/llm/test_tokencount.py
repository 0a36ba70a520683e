import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcast.llm import tokencount

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = [None, "", " ", "a", "  two  spaces   ", "line\nline\n\n  indented\ttab\r\n", "the the the of and", "日本語 кириллица ñandú é𝔘 \U0001f600", "x" * 5000, "\x00\x01 \x0b", "▁ ▁a", "trailing ", "a" * 7 + " " * 40 + "b"]


@pytest.fixture(scope="module")
def solver():
    return tokencount.counter(PATH)


@pytest.fixture(scope="module")
def unigram():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    v = tokencount.Vocabulary.load(PATH)
    vocab = [("<unk>", v.lowest), *[(f"<0x{b:02X}>", v.lowest) for b in range(256)], *v.pieces.items()]
    model = Tokenizer(Unigram(vocab, unk_id=0, byte_fallback=True))
    return lambda text: len(model.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


def test_counts_equal_the_tokenizer(solver, unigram):
    counts, _ = solver.count_batch(pa.array(HARD, pa.string()))
    assert counts.tolist() == [unigram(x or "") for x in HARD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aeinthro .,\nñ漢▁😀T", max_size=25), max_size=4))
def test_counts_of_any_text(batch):
    solver = tokencount.counter(PATH)
    counts, _ = solver.count_batch(pa.array(batch, pa.string()))
    assert counts.tolist() == [slow(solver, x)[0] for x in batch]


def slow(solver, text):
    """Forward over starts, replacing only what is strictly better."""
    if not text:
        return 0, 0.0
    text = "▁" + text.replace(" ", "▁")
    pieces = tokencount.Vocabulary.load(PATH).pieces if not hasattr(slow, "pieces") else slow.pieces
    slow.pieces = pieces
    best = [(0.0, 0)] + [None] * len(text)
    for i in range(len(text)):
        for k in range(1, 17):
            if i + k <= len(text) and text[i : i + k] in pieces:
                value = best[i][0] + pieces[text[i : i + k]]
                if best[i + k] is None or value > best[i + k][0]:
                    best[i + k] = value, best[i][1] + 1
        if text[i] not in pieces:
            value = best[i][0] + solver.unknown
            if best[i + 1] is None or value > best[i + 1][0]:
                best[i + 1] = value, best[i][1] + len(text[i].encode())
    return best[-1][1], best[-1][0]


def test_scores(solver):
    _, scores = solver.count_batch(pa.array(HARD, pa.string()))
    assert scores.tolist() == [slow(solver, x)[1] for x in HARD]


def test_query(spark):
    docs = spark.createDataFrame([(None, "a b", "z"), (1, None, "z"), (1, "x", "z")], "doc_id long, text string, n_tokens string")
    got = tokencount.count_tokens(docs, PATH).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 0), (False, 1), (True, 2)]
    assert tokencount.count_tokens(docs.limit(0), PATH).collect() == []
