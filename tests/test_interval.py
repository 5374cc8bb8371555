"""Interval joins against all pairs, on every kind of interval that makes cells uneven."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tabscope.operators.interval import interval_join, interval_totals, overlap_join

def holds(x, a, b, closed):
    above = a is None or (x >= a if closed in ("left", "both") else x > a)
    return above and (b is None or (x <= b if closed in ("right", "both") else x < b))


def uneven(rng, n):
    """Points with a hot value, a dense region and strays."""
    out = [rng.choice([5.0, rng.gauss(0, 1), rng.uniform(-1e6, 1e6), float(rng.randrange(20))]) for _ in range(n)]
    return out + [float("inf"), float("-inf"), 1e300, None]


def spans(rng, n):
    """Short, nested, long, empty, touching and inverted intervals, with null ends."""
    out = []
    for _ in range(n):
        a = rng.choice([5.0, rng.gauss(0, 1), rng.uniform(-1e6, 1e6), float(rng.randrange(20))])
        out.append((a, a + rng.choice([0.0, 1e-3, 0.5, 1.0, 30.0, 2e6, -1.0])))
    return out + [(None, 3.0), (3.0, None), (None, None), (float("-inf"), float("inf")), (5.0, 5.0)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("closed", ["left", "right", "both", "neither"])
@pytest.mark.parametrize("rows_per_bin", [8, 100, 65_536])
def test_points_in_intervals(spark, closed, rows_per_bin):
    rng = random.Random(rows_per_bin)
    xs, ivs = uneven(rng, 400), spans(rng, 150)
    points = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "p int, x double").repartition(5)
    intervals = spark.createDataFrame([(i, *iv) for i, iv in enumerate(ivs)], "q int, a double, b double").repartition(3)
    for unbounded in (False, True):
        joined = interval_join(points, intervals, "x", "a", "b", closed=closed, unbounded=unbounded, rows_per_bin=rows_per_bin)
        assert joined.columns == ["p", "x", "q", "a", "b"]
        want = []
        for i, x in enumerate(xs):
            for j, (a, b) in enumerate(ivs):
                if x is None or (not unbounded and None in (a, b)) or (None not in (a, b) and a > b):
                    continue
                fits = holds(x, a, b, closed)
                if fits:
                    want.append((i, j))
        assert sorted((r.p, r.q) for r in joined.collect()) == sorted(want)
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)


@pytest.mark.parametrize("rows_per_bin", [8, 65_536])
def test_left_join_and_keys(spark, rows_per_bin):
    rng = random.Random(3)
    points = [(i, rng.choice(["hot"] * 5 + ["a", "b", None]), x) for i, x in enumerate(uneven(rng, 400))]
    intervals = [(j, rng.choice(["hot"] * 5 + ["a", "c", None]), *iv) for j, iv in enumerate(spans(rng, 120))]
    left = spark.createDataFrame(points, "p int, k string, x double").repartition(4)
    right = spark.createDataFrame(intervals, "q int, k string, a double, b double")
    got = interval_join(left, right, "x", "a", "b", keys=["k"], how="left", rows_per_bin=rows_per_bin)
    assert got.columns == ["p", "k", "x", "q", "a", "b"]
    want = []
    for i, k, x in points:
        hits = [j for j, m, a, b in intervals if None not in (k, x, a, b) and k == m and a <= x < b]
        want += [(i, j) for j in hits] or [(i, -1)]
    assert sorted((r.p, -1 if r.q is None else r.q) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("rows_per_bin", [8, 65_536])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_overlaps(spark, closed, rows_per_bin, keys):
    rng = random.Random(9)
    sides = [[(i, rng.randrange(3), *iv) for i, iv in enumerate(spans(rng, n))] for n in (200, 130)]
    if not keys:
        sides = [[(i, 0, a, b) for i, _, a, b in side] for side in sides]
    left = spark.createDataFrame(sides[0], "p int, k int, a double, b double")
    right = spark.createDataFrame(sides[1], "q int, k int, c double, d double")
    if not keys:
        left, right = left.drop("k"), right.drop("k")
    got = overlap_join(left, right, ("a", "b"), ("c", "d"), keys, closed, rows_per_bin)
    want = []
    for i, k, a, b in sides[0]:
        for j, m, c, d in sides[1]:
            if k == m and None not in (a, b, c, d) and a <= b and c <= d and (a <= d and c <= b if closed else a < d and c < b):
                want.append((i, j))
    assert sorted((r.p, r.q) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "bigint", "decimal(20,4)"])
def test_types(spark, kind):
    rows = [(i, i * 37 % 101) for i in range(300)]
    cast = {
        "date": lambda c: F.date_add(F.lit(datetime.date(2024, 1, 1)), c),
        "timestamp": lambda c: F.timestamp_seconds(F.col(c) * 3600),
        "timestamp_ntz": lambda c: F.timestamp_seconds(F.col(c) * 3600).cast("timestamp_ntz"),
    }.get(kind, lambda c: F.col(c).cast(kind))
    points = spark.createDataFrame(rows, "p int, n int").select("p", cast("n").alias("x"))
    intervals = spark.createDataFrame([(j, a, b) for j, a, b in ((0, 5, 9), (1, 50, 51), (2, -5, 200))], "q int, l int, h int")
    intervals = intervals.select("q", cast("l").alias("a"), cast("h").alias("b"))
    got = interval_join(points, intervals, "x", "a", "b", rows_per_bin=20).groupBy("q").count().collect()
    assert {r.q: r["count"] for r in got} == {q: sum(a <= n < b for _, n in rows) for q, a, b in ((0, 5, 9), (1, 50, 51), (2, -5, 200))}


def test_empty_sides_and_wrong_calls(spark):
    points = spark.createDataFrame([(1, 2.0)], "p int, x double")
    intervals = spark.createDataFrame([(1, 1.0, 3.0)], "q int, a double, b double")
    assert interval_join(points, intervals, "x", "a", "b").count() == 1
    assert interval_join(points.limit(0), intervals, "x", "a", "b").count() == 0
    assert interval_join(points, intervals.limit(0), "x", "a", "b").count() == 0
    assert interval_join(points, intervals.limit(0), "x", "a", "b", how="left").collect() == [(1, 2.0, None, None, None)]
    with pytest.raises(ValueError, match="rename"):
        interval_join(points, intervals.withColumn("p", F.lit(1)), "x", "a", "b")
    with pytest.raises(ValueError, match="different types"):
        interval_join(points, intervals.withColumn("a", F.current_date()), "x", "a", "b")


def test_hot_values_are_shared_out(spark):
    """A value that half of the points have, in an interval start that half of the intervals have."""
    points = spark.range(4_000).selectExpr("id as p", "if(id % 2 = 0, 7.0d, cast(id as double)) as x")
    intervals = spark.range(300).selectExpr("id as q", "if(id % 2 = 0, 7.0d, cast(id as double)) as a", "if(id % 2 = 0, 7.0d, cast(id as double)) + 1 as b")
    joined = interval_join(points, intervals, "x", "a", "b", rows_per_bin=50)
    assert joined.count() == 2_000 * 150 + sum(1 for q in range(1, 300, 2) for x in (q, q + 1) if x % 2 and x < q + 1) + 2_000 * 1 + 150 * 1


def test_no_side_is_broadcast(spark):
    """Estimates do not count how often a row is sent to cells, so size thresholds must not choose the join."""
    points = spark.range(500).selectExpr("id as p", "cast(id as double) as x", "cast(id + 3 as double) as y")
    intervals = spark.range(90).selectExpr("id as q", "cast(id * 2 as double) as a", "cast(id * 2 + 5 as double) as b")
    joined = overlap_join(points, intervals, ("x", "y"), ("a", "b"), rows_per_bin=50)
    assert "SortMergeJoin" in plan(joined) and "Broadcast" not in plan(joined)
    assert joined.count() == sum(x <= 2 * q + 5 and 2 * q <= x + 3 for x in range(500) for q in range(90))


@pytest.mark.parametrize("closed", ["left", "right", "both", "neither"])
@pytest.mark.parametrize("rows_per_bin", [4, 65_536])
def test_totals_are_those_of_the_pairs(spark, closed, rows_per_bin):
    rng = random.Random(rows_per_bin)
    xs = uneven(rng, 400) + [float("nan")] * 2 + [0.0, -0.0]
    points = [(x, rng.choice([None, 3, 10**18, -7]), rng.choice([None, 1])) for x in xs]
    ends = spans(rng, 150) + [(5.0, 6.0)] * 60 + [(0.0, 0.0), (-0.0, 0.0), (0.0, float("nan")), (float("nan"), float("nan"))]
    left = spark.createDataFrame(points, "x double, v long, w long").withColumn("w", F.col("w").cast("decimal(9,2)") / 4).repartition(5)
    right = spark.createDataFrame([(rng.choice([None, *range(40)]), *e) for e in ends], "g int, a double, b double")
    pairs = interval_join(left, right, "x", "a", "b", closed=closed)
    want = pairs.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("w").alias("w"))
    got = interval_totals(left, right, "x", "a", "b", ["g"], "n", {"v": "v", "w": "w"}, closed, rows_per_bin)
    assert got.columns == ["g", "n", "v", "w"]
    assert {r.g: tuple(r) for r in got.collect()} == {r.g: tuple(r) for r in want.collect()}


def test_totals_make_no_pairs(spark):
    """A billion pairs of 60,000 rows: pairs one by one took longer than any test may."""
    points = spark.range(30_000).selectExpr("id % 10000 as x", "id as v")
    intervals = spark.range(30_000).selectExpr("id % 7 as g", "id % 2 as a", "10000 as b")
    got = {r.g: (r.n, r.s) for r in interval_totals(points, intervals, "x", "a", "b", ["g"], "n", {"s": "v"}, rows_per_bin=500).collect()}
    start = {a: (3 * (10_000 - a), sum(v for v in range(30_000) if v % 10_000 >= a)) for a in (0, 1)}
    many = {g: [sum(1 for q in range(g, 30_000, 7) if q % 2 == a) for a in (0, 1)] for g in range(7)}
    assert got == {g: tuple(sum(many[g][a] * start[a][k] for a in (0, 1)) for k in (0, 1)) for g in range(7)}
    assert interval_totals(points, intervals.limit(0), "x", "a", "b", ["g"], "n", {}).collect() == []
    assert interval_totals(points.limit(0), intervals, "x", "a", "b", ["g"], "n", {}).collect() == []
    with pytest.raises(ValueError, match="no exact sums"):
        interval_totals(points.withColumn("v", F.lit(1.0)), intervals, "x", "a", "b", ["g"], "n", {"s": "v"})


def test_interval_query_makes_no_pairs(spark, sf_dir):
    from tabscope.plans.coverage import QUERIES

    assert "_level" not in plan(QUERIES["sql_join_interval"](spark, sf_dir))
