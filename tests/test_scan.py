"""Running values against a plain loop, with hot keys, bursts and ties cut into parts."""

from __future__ import annotations

import datetime
import decimal
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabscope.operators.asof import asof_join
from tabscope.operators.scan import find_parts, running

START = datetime.datetime(2024, 1, 1)


def rows_of(rng, n):
    out = []
    for i in range(n):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        time = START if rng.random() < 0.6 else START + datetime.timedelta(seconds=rng.randrange(-50, 50))
        out.append((i, key, None if rng.random() < 0.02 else time, rng.choice([None, rng.randrange(-9, 9)])))
    return out


@pytest.mark.parametrize("part_rows", [20, 1_000_000])
def test_running_values(spark, part_rows):
    rows = rows_of(random.Random(1), 900)
    df = spark.createDataFrame(rows, "i int, k string, t timestamp_ntz, v int").repartition(6)
    df = df.withColumn("d", F.col("v").cast("decimal(10,2)"))
    values = {"total": ("sum", "d"), "n": ("count", "v"), "least": ("min", "v"), "most": ("max", "v"), "latest": ("last", "v")}
    got = {r.i: r for r in running(df, ["k"], ["t", "i"], values, part_rows).collect()}
    assert len(got) == len(rows)
    state: dict = {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or START, r[0])):
        seen, latest = state.setdefault(k, ([], [None]))
        if v is not None:
            seen.append(v)
            latest[0] = v
        want = (decimal.Decimal(sum(seen)) if seen else None, len(seen), min(seen, default=None), max(seen, default=None), latest[0])
        r = got[i]
        assert (r.total, r.n, r.least, r.most, r.latest) == want


def test_ties_in_all_of_the_order_are_cut(spark):
    df = spark.range(5_000).select(F.lit("hot").alias("k"), F.lit(START).cast("timestamp_ntz").alias("t"), F.lit(1).alias("one"), "id")
    got = running(df, ["k"], ["t"], {"n": ("count", "one")}, part_rows=300)
    assert sorted(r.n for r in got.collect()) == list(range(1, 5_001))


@pytest.mark.parametrize("strict", [False, True])
def test_asof_with_a_burst_and_a_hot_key(spark, strict):
    """Most rows lie in one instant of one key; no part holds more than a few times its size."""
    rng = random.Random(5)
    sides = [rows_of(rng, n) for n in (1_500, 400)]
    left, right = (spark.createDataFrame([r[:3] for r in s], "i int, k string, t timestamp_ntz") for s in sides)
    got = {r.i: r.asof_r for r in asof_join(left, right.withColumnRenamed("i", "r"), "k", "t", ["r"], strict, part_rows=50).collect()}
    want = {}
    for i, k, t, _ in sides[0]:
        fits = [(rt, r) for r, rk, rt, _ in sides[1] if None not in (k, t, rt) and rk == k and (rt < t or (rt == t and not strict))]
        want[i] = max(fits)[1] if fits else None
    assert got == want


def test_parts_are_bounded(spark):
    """What the windows sort: rows by key and part, one second holding half of them."""
    rows = spark.range(20_000).select(
        F.xxhash64(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id"))).alias("h"),
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("o"),
        F.xxhash64("id").alias("n"),
    )
    parts = find_parts(rows, "h", "o", "n", 500)
    assert len(parts.borders) == 1
    sizes = Counter((r.h, r.p) for r in rows.select("h", parts.part(F.col("h"), F.col("o"), F.col("n")).alias("p")).collect())
    assert max(sizes.values()) <= 1_000 and sum(sizes.values()) == 20_000
    # the part never falls as the order rises
    last = -1
    for r in rows.where(F.col("h").isin(list(parts.borders))).select("o", "n", parts.part(F.col("h"), F.col("o"), F.col("n")).alias("p")).orderBy("o", "n").collect():
        assert r.p >= last
        last = r.p


def test_borders_are_cut_once(spark):
    """The borders are arrays of the plan: no row takes them apart again. Several keys are hot."""
    rows = spark.range(6_000).select((F.col("id") % 3).alias("h"), F.expr("id div 600").alias("o"), F.xxhash64("id").alias("n"))
    parts = find_parts(rows, "h", "o", "n", 200)
    assert sorted(parts.borders) == [0, 1, 2]
    placed = rows.withColumn("p", parts.part(F.col("h"), F.col("o"), F.col("n")))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert not any(f in plan for f in ("split(", "transform(", "substring_index("))
    first = {}
    for r in placed.collect():
        want = sum(border <= (r.o, r.n) for border in parts.borders[r.h])
        assert r.p - want == first.setdefault(r.h, r.p - want)


def test_wrong_calls(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "x")], "k string, t int, v double, s string")
    with pytest.raises(ValueError, match="rename"):
        running(df, ["k"], ["t"], {"v": ("sum", "v")})
    with pytest.raises(ValueError, match="no running"):
        running(df, ["k"], ["t"], {"x": ("median", "v")})
    with pytest.raises(ValueError, match="no order"):
        running(df, ["k"], ["s"], {"x": ("sum", "v")})
    assert running(df.limit(0), ["k"], ["t"], {"x": ("sum", "v")}).count() == 0
