"""Every registered query against its SQL in DuckDB, whole results."""

import os

import pytest

import __spark_entry__ as entry
from checks import ALL
from checks.compare import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {name: query for module in ALL for name, query in module.QUERIES.items()}
SQL = {name: sql for module in ALL for name, sql in module.ORACLE.items()}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in SQL
    problem, _ = compare(name, QUERIES[name](spark, SF), con, SQL[name])
    assert problem is None, problem


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_no_orphan_sql():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
