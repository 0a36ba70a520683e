import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcast.llm import quality

from . import brute

LINE = "one two three four five six seven eight nine ten eleven twelve\n"
HARD = [None, "", " \n\n ", "#", LINE * 9, "a " * 200, "été ÉTÉ 日本 語 " * 20, LINE + "x y z\n" + LINE, "x\x0by\x0cz\tx", "\n".join(f"w{i} v{i % 7}" for i in range(80)), "ab ab\nab ab\n\nab ab", "$|<> *&%#"]


def check(batch):
    got = quality.measure_batch(pa.array(batch, pa.string()))
    for i, text in enumerate(batch):
        want = brute.quality(text, quality.MIN_REPEAT, quality.MAX_COVER, quality.MAX_REPEAT)
        assert {k: got[k][i] for k in want} == want, text


def test_measures():
    check(HARD)
    check([None])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c\n", "d"]), max_size=90).map(" ".join), max_size=4))
def test_measures_of_any_text(batch):
    check(batch)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([LINE, "a b c d e f g h i j k ", "z ", "q r s t u v w x y z a b c "]), max_size=16).map("".join))
def test_measures_of_long_repeats(text):
    check([text, "tail " + text])


def test_query(spark):
    docs = spark.createDataFrame([(None, "a b", 7), (1, None, 8), (1, "x", 9)], "doc_id long, text string, n_words int")
    got = quality.measure(docs).collect()
    assert sorted((r.doc_id is None, r.n_words) for r in got) == [(False, 0), (False, 1), (True, 2)]
    assert quality.measure(docs.limit(0)).collect() == []
