"""Every registered query runs on the smallest tables and equals its SQL there."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def database(sf):
    return connect(sf)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, sf, name):
    _, _, rows, problem = compare(spark, database, sf, QUERIES[name], ORACLES.get(name))
    assert problem is None, problem
    assert rows > 0
