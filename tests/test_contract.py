"""Every registered query runs, and equals its SQL twin where it has one."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_twins_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    problem, got, _, _ = compare(spark, con, queries()[name], oracle_sql().get(name), SF_DIR)
    assert problem is None
    assert got[2]


def test_entry(spark):
    assert entry(spark).columns == ["query_id", "id", "score", "rank", "text"]
