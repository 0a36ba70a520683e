import os

import pytest

from loomcast.plans import catalogue

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        compare(df, con, sql)


def test_batch_and_stream_agree(spark):
    batch = catalogue.queries()["state_phases"](spark, SF).collect()
    stream = catalogue.queries()["stream_phases"](spark, SF).collect()
    assert sorted(batch, key=lambda r: r.event_id) == sorted(stream, key=lambda r: r.event_id)
