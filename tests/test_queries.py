"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest
from oracle import database, difference

import __spark_entry__ as entry
from workload.oracles import ORACLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
SQL = entry.oracle_sql()
QUERIES = {name: query for name, query in entry.queries().items() if name in ORACLES}


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) <= set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_entry(spark):
    out = entry.entry(spark)
    assert len(out.columns) == 2 + 1 + 29 and out.limit(1).count() == 1
