"""Every registered query against its oracle SQL; queries without one must run."""

from __future__ import annotations

import pytest
from oracle import compare, connect

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = connect(sf_dir)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.columns and df.count() > 0


def test_oracle_names_are_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_compare_sees_differences(spark, con):
    df = spark.sql("SELECT 1 AS a, 2.0D AS b")
    assert compare(df, con, "SELECT 1 AS a, CAST(2.0 AS DOUBLE) AS b") is None
    assert compare(df, con, "SELECT 1 AS a, CAST(3.0 AS DOUBLE) AS b")
    assert compare(df, con, "SELECT 1 AS a, CAST(2.0 AS DOUBLE) AS c")
    assert compare(df, con, "SELECT 1 AS a, CAST(2.0 AS DOUBLE) AS b UNION ALL SELECT 1, 2.0")


def test_entry(spark):
    assert contract.entry(spark).count() == 1
