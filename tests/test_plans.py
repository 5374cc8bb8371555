"""The physical plans are the ones meant: built-ins only, pushed filters, early limits."""

from __future__ import annotations

import pytest

from tabscope.operators.columns import top_from_histogram
from tabscope.operators.classes import column_infos
from tabscope.operators.histogram import text_histogram
from tabscope.operators.trend import change_by_dimension, metric_by_dimension
from tabscope.plans.coverage import QUERIES
from tabscope.plans.coverage.registry import table
from tabscope.plans.profile import text_statistics


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_nested_loops(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text, node


def test_top_values_cut_early(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = plan(top_from_histogram(text_histogram(docs, [i for i in column_infos(docs) if i.dtype == "string"]), 5))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_distinct_and_top_values_share_the_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    df = text_statistics(docs, [i for i in column_infos(docs) if i.dtype == "string"])
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == 1


def test_trend_scan_is_narrow_and_filtered(spark, sf_dir):
    text = plan(change_by_dimension(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "o_orderstatus", "1997-03", "1997-02"))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(o_orderdate" in scan
    schema = scan[scan.index("ReadSchema") :]
    assert "o_orderkey" not in schema and "o_custkey" not in schema


def test_share_scans_once(spark, sf_dir):
    df = metric_by_dimension(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    df.collect()
    assert "ReusedExchange" in plan(df)
