from __future__ import annotations

import datetime
import random

import pytest

from tabscope import frame_trend
from tabscope.operators.asof import asof_join
from tabscope.operators.trend import (
    change_by_dimension,
    choose_trend_columns,
    largest_drop,
    metric_by_dimension,
    month_over_month,
    monthly_sum,
)

START = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("slice_seconds", [0.5, 60, None])
def test_asof_with_a_hot_key(spark, strict, slice_seconds):
    rng = random.Random(3)

    def side(n):
        return [(rng.choice(["hot"] * 4 + ["a", "b"]), START + datetime.timedelta(seconds=rng.randrange(3000)), i) for i in range(n)]

    lefts, rights = side(300), side(150)
    left = spark.createDataFrame(lefts, "k string, t timestamp_ntz, l int")
    right = spark.createDataFrame(rights, "k string, t timestamp_ntz, r int")
    got = {r["l"]: r["asof_r"] for r in asof_join(left, right, "k", "t", ["r"], strict, slice_seconds).collect()}
    want = {}
    for k, t, i in lefts:
        fitting = [(rt, r) for rk, rt, r in rights if rk == k and (rt < t or (rt == t and not strict))]
        want[i] = max(fitting)[1] if fitting else None
    assert got == want


def test_asof_without_key_or_time(spark):
    rows = [(None, START, 1), ("a", None, 2), ("a", START, 3)]
    left = spark.createDataFrame(rows, "k string, t timestamp_ntz, l int")
    right = spark.createDataFrame(rows, "k string, t timestamp_ntz, r int")
    got = {r["l"]: r["asof_r"] for r in asof_join(left, right, "k", "t", ["r"]).collect()}
    assert got == {1: None, 2: None, 3: 3}
    assert asof_join(left, right.limit(0), "k", "t", ["r"]).where("asof_r is null").count() == 3


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        ("2024-01-05", "North", 100.0), ("2024-01-20", "South", 50.0), ("2024-02-01", "North", 300.0),
        ("2024-04-01", "North", 90.0), ("2024-04-02", "South", 60.0), ("bad", "North", 5.0),
        ("2024-04-03", "East", None), (None, "East", 7.0), ("2023-12-31", "East", 10.0),
    ]
    return spark.createDataFrame(rows, "d string, region string, revenue double")


def test_monthly(sales):
    monthly = monthly_sum(sales, "d", "revenue")
    assert [tuple(r) for r in monthly.collect()] == [("2023-12", 10.0), ("2024-01", 150.0), ("2024-02", 300.0), ("2024-04", 150.0)]
    changes = [(r["previous"], r["change"], r["change_pct"]) for r in month_over_month(monthly).orderBy("month").collect()]
    assert changes == [(None, None, None), (10.0, 140.0, 1400.0), (150.0, 150.0, 100.0), (300.0, -150.0, -50.0)]
    assert largest_drop(monthly) == ("2024-04", "2024-02")
    assert largest_drop(monthly.limit(3)) is None
    assert monthly_sum(sales.limit(0), "d", "revenue").count() == 0


def test_change_by_dimension(sales):
    rows = change_by_dimension(sales, "d", "revenue", "region", "2024-04", "2024-02").collect()
    assert [tuple(r) for r in rows] == [("North", 300.0, 90.0, -210.0), ("South", 0.0, 60.0, 60.0)]
    december = change_by_dimension(sales, "d", "revenue", "region", "2024-01", "2023-12").collect()
    assert [r["region"] for r in december] == ["East", "South", "North"]


def test_metric_by_dimension(sales):
    rows = [tuple(r) for r in metric_by_dimension(sales, "region", "revenue").collect()]
    assert [r[:2] for r in rows] == [("North", 495.0), ("South", 110.0), ("East", 17.0)]
    assert sum(r[2] for r in rows) == pytest.approx(1.0)


def test_trend_of_a_table(spark, sales):
    assert [r["total"] for r in frame_trend(sales).collect()] == [10.0, 150.0, 300.0, 150.0]
    years = spark.createDataFrame([(2024, 1.0), (2025, 2.0)], "year int, amount double")
    assert frame_trend(years) is None
    assert frame_trend(sales.select("region", "revenue")) is None


def test_choice_of_columns():
    roles = {"date_columns": ["d", "e"], "revenue_columns": [], "metric_columns": ["m"]}
    assert choose_trend_columns(roles) == ("d", "m")
    assert choose_trend_columns({**roles, "revenue_columns": ["r"]}) == ("d", "r")
    assert choose_trend_columns({**roles, "date_columns": []}) is None
    assert choose_trend_columns({**roles, "metric_columns": []}) is None


def test_asof_parts_do_not_depend_on_a_stray_time(spark):
    """Parts hold rows, whatever the span of their times; in place of the test of slices by density."""
    from tabscope.operators.scan import find_parts

    def borders(n, stray):
        rows = spark.range(n).selectExpr("1L as h", "id + 1000000 as o", "xxhash64(id) as n")
        return find_parts(rows.unionAll(spark.sql("select 1L, -9000000000L, 1L")) if stray else rows, "h", "o", "n", 100).borders[1]

    even, odd = borders(1000, False), borders(1000, True)
    assert len(even) == 9 and len(odd) <= 10
    assert all(abs(a[0] - b[0]) <= 1 for a, b in zip(even, odd))


def test_asof_with_a_stray_time_and_repeated_right_rows(spark):
    late = START + datetime.timedelta(seconds=50)
    left = spark.createDataFrame([("a", late, 1), ("a", START, 2), (None, late, 3), ("a", None, 4)], "k string, t timestamp_ntz, l int")
    rights = [("a", START, 7), ("a", START, 9), ("a", START, 9), ("a", datetime.datetime(1970, 1, 1), 1), (None, START, 5)]
    right = spark.createDataFrame(rights, "k string, t timestamp_ntz, r int")
    for slice_seconds in (None, 10):
        got = asof_join(left, right, "k", "t", ["r"], slice_seconds=slice_seconds).collect()
        assert {r["l"]: r["asof_r"] for r in got} == {1: 9, 2: 9, 3: None, 4: None}
        assert len(got) == 4
    strict = asof_join(left, right, "k", "t", ["r"], strict=True).collect()
    assert {r["l"]: r["asof_r"] for r in strict} == {1: 9, 2: 1, 3: None, 4: None}
