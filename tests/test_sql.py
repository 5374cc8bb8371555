from __future__ import annotations

import pytest

from tabscope import open_workspace, run_sql
from tabscope.plans.sql import as_paths, view_name


@pytest.fixture(scope="module")
def sales(tmp_path_factory) -> str:
    path = tmp_path_factory.mktemp("sql") / "my sales-1.csv"
    path.write_text("region,revenue,note\nNorth,100,NA\nWest,200,\nEast,150,null\n", encoding="utf-8")
    return str(path)


def test_group_by(spark, sales):
    result = run_sql(
        spark, "SELECT region, SUM(revenue) AS total FROM my_sales_1 GROUP BY region ORDER BY total DESC", sales
    )
    assert result.error is None and result.row_count == 3 and not result.truncated
    assert result.column_names == ["region", "total"]
    assert result.preview_rows[0] == {"region": "West", "total": 200}


def test_null_tokens_stay_text(spark, sales):
    rows = run_sql(spark, "SELECT note FROM my_sales_1", [sales]).preview_rows
    assert [r["note"] for r in rows] == ["NA", None, "null"]


def test_preview_is_bounded(spark, sf_dir):
    result = run_sql(spark, "SELECT o_orderkey FROM orders;", f"{sf_dir}/orders.parquet", max_rows=7)
    assert len(result.preview_rows) == 7 and result.truncated and result.row_count == 1500
    exact = run_sql(spark, "SELECT o_orderkey FROM orders LIMIT 7", f"{sf_dir}/orders.parquet", max_rows=7)
    assert len(exact.preview_rows) == 7 and not exact.truncated and exact.row_count == 7


def test_two_datasets(spark, sf_dir):
    paths = [f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet"]
    result = run_sql(spark, "SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey", paths)
    assert result.row_count == 25


@pytest.mark.parametrize(
    ("query", "paths", "message"),
    [
        ("SELECT nope FROM region", "region.parquet", "nope"),
        ("SELEC 1", "region.parquet", "SELEC"),
        ("SELECT 1", "missing.parquet", "Data file not found"),
        ("SELECT 1", "book.xlsx", "Data file not found"),
        ("SELECT 1/0 FROM region", "region.parquet", "DIVIDE_BY_ZERO"),
    ],
)
def test_errors_are_returned(spark, sf_dir, query, paths, message):
    result = run_sql(spark, query, f"{sf_dir}/{paths}")
    assert message in result.error and result.row_count == 0 and result.column_names == []
    assert result.execution_time_seconds >= 0


def test_unsupported_file(spark, tmp_path):
    book = tmp_path / "book.xlsx"
    book.write_bytes(b"x")
    assert "Unsupported data file for SQL: .xlsx" in run_sql(spark, "SELECT 1", str(book)).error


def test_views_do_not_leak(spark, sf_dir):
    open_workspace(spark, f"{sf_dir}/region.parquet")
    assert "region" not in [t.name for t in spark.catalog.listTables()]


def test_same_stem(spark, sf_dir, tmp_path):
    copy = tmp_path / "region.parquet"
    spark.range(1).write.parquet(str(copy))
    with pytest.raises(ValueError, match="share the view name region"):
        open_workspace(spark, [f"{sf_dir}/region.parquet", str(copy)])


def test_odd_stems(spark, tmp_path):
    path = tmp_path / "2024.q1 select.parquet"
    spark.range(3).write.parquet(str(path))
    assert view_name(str(path)) == "2024.q1_select"
    assert run_sql(spark, "SELECT * FROM `2024.q1_select`", str(path)).row_count == 3


def test_default_paths(spark, sf_dir):
    assert as_paths("a") == ["a"] and as_paths(None, "b") == ["b"] and as_paths(["c"], "b") == ["c"] and as_paths(None) == []
    result = run_sql(spark, "SELECT * FROM region", default_paths=f"{sf_dir}/region.parquet")
    assert result.row_count == 5


def test_describe_and_ddl(spark, sf_dir):
    described = run_sql(spark, "DESCRIBE QUERY SELECT * FROM region", f"{sf_dir}/region.parquet")
    assert [r["col_name"] for r in described.preview_rows] == ["r_regionkey", "r_name"]
    assert run_sql(spark, "CREATE TEMP VIEW v AS SELECT 1 AS one").error is None


def test_child_keeps_settings(spark, sf_dir):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        child = open_workspace(spark, f"{sf_dir}/region.parquet")
        assert child.conf.get("spark.sql.shuffle.partitions") == "5"
        assert child.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
