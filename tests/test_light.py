"""Roles and warnings from light statistics equal those of the full profile."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabscope.operators.classes import column_infos
from tabscope.operators.duplicates import duplicate_count
from tabscope.operators.roles import ROLES, quality_warnings, with_roles
from tabscope.plans.light import light_statistics, needs_distinct
from tabscope.plans.profile import profile_columns

SCHEMA = (
    "order_id bigint, uuid string, `unit price` double, flag boolean, city string, day date, seen timestamp,"
    " same string, near string, empty string, no_date timestamp, nan double, tags array<string>, m map<string,int>,"
    " code bigint, small int, sale_key string, wide decimal(20,2)"
)


def _rows(n: int) -> list[tuple]:
    import datetime as dt

    head = "h" * 70
    return [
        (i, f"u{i}", i / 3, i % 2 == 0, f"c{i % 3}", dt.date(2024, 1, 1 + i % 5), dt.datetime(2024, 1, 1, i % 24),
         head, head + str(i % 2), None, None, float("nan") if i % 2 else 1.0, ["a", str(i % 2)], {"k": i % 4},
         i, i % 4, f"k{i % 2}", None if i % 3 else Decimal(5))
        for i in range(n)
    ]


def _flags(stats, rows):
    return {r["name"]: tuple(r[f"is_{x}"] for x in ROLES) for r in with_roles(stats, rows).collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40])
def test_equal_to_the_full_profile(spark, n):
    df = spark.createDataFrame(_rows(n), SCHEMA).repartition(3)
    light, full = light_statistics(df), profile_columns(df)
    assert light[1] == full[1] == n
    assert _flags(*light) == _flags(*full)
    same = ["ordinal", "name", "dtype", "kind", "missing_count", "missing_pct", "date_min"]
    assert sorted(map(tuple, light[0].select(*same).collect())) == sorted(map(tuple, full[0].select(*same).collect()))
    repeats = duplicate_count(df)
    only = light_statistics(df, distinct=False)[0]
    assert sorted(map(tuple, quality_warnings(only, repeats).collect())) == sorted(
        map(tuple, quality_warnings(full[0], repeats).collect())
    )


def test_counted_columns(spark):
    infos = {i.name: needs_distinct(i) for i in column_infos(spark.createDataFrame([], SCHEMA))}
    assert [n for n, counted in infos.items() if not counted] == ["uuid", "unit price", "day", "seen", "no_date", "sale_key"]


def test_warnings_shuffle_no_rows(spark):
    df = spark.range(10).select(F.col("id").alias("x"), F.lit("t").alias("y"))
    stats, _ = light_statistics(df, distinct=False)
    assert [(r["name"], r["unique_count"]) for r in stats.orderBy("ordinal").collect()] == [("x", None), ("y", 1)]
