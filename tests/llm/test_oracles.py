"""The registered queries of this package against their SQL on the smallest tables."""

import pytest

from strandspark.llm.oracles import ORACLES
from strandspark.llm.queries import QUERIES

from compare import connect, differing

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differing(QUERIES[name](spark, SMALL), con, ORACLES[name])[:3] == []
