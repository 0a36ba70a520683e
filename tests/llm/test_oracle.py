import os

import pytest

pytest.importorskip("public_tokenizers")

from loomcast.llm import queries

from ..oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) == 200


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_whole_table(spark, name):
    df = queries.queries()[name](spark, SF)
    docs = queries.table(spark, SF, "documents").select("doc_id")
    assert df.select("doc_id").distinct().count() == docs.count() == df.join(docs, "doc_id", "left_semi").select("doc_id").distinct().count()
