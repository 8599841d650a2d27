"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from strandspark.oracles import ORACLES
from strandspark.queries import QUERIES

from compare import connect, differing

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differing(QUERIES[name](spark, SMALL), con, ORACLES[name])[:3] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_iteration_query_recovers(spark):
    assert QUERIES["i2_iterate"](spark, SMALL).first()["recovered"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert len(entry.entry(spark).first()["consensus"]) > 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
