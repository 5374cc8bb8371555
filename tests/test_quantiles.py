from __future__ import annotations

import numpy as np
import pytest

from tabscope.operators.quantiles import approximate_quantiles, exact_quantiles

RNG = np.random.default_rng(7)
SHAPES = {
    "uniform": RNG.random(5000),
    "hot_value": np.concatenate([np.zeros(2000), RNG.normal(size=3000)]),
    "hot_at_quartile": np.concatenate([np.arange(1250.0), np.full(2500, 5000.0), 9000 + np.arange(1250.0)]),
    "two_values": np.repeat([1.0, 2.0], 2500),
    "wide": np.sign(RNG.normal(size=5000)) * 10.0 ** RNG.uniform(-200, 200, 5000),
    "infinite": np.concatenate([[-np.inf, np.inf], RNG.random(4998)]),
    "constant": np.full(5000, 3.25),
}


@pytest.mark.parametrize("limits", [(50, 400), (1000, 10**6), (10**6, 10**6)])
def test_exact(spark, limits):
    leaf, pivots = limits
    rows = list(zip(*[v.tolist() for v in SHAPES.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in SHAPES)).repartition(4)
    got = exact_quantiles(df, (0.25, 0.5, 0.75, 0.99), leaf_rows=leaf, pivot_rows=pivots)
    for row, values in zip(sorted(got.collect()), SHAPES.values()):
        assert row["quantiles"] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.75, 0.99]), rel=1e-12)


def test_missing_and_integers(spark):
    rows = [(None if i % 3 == 0 else i, float("nan") if i % 2 else float(i), None) for i in range(1000)]
    df = spark.createDataFrame(rows, "a bigint, b double, c int")
    for leaf in (100, 10**6):
        got = {r["ordinal"]: r["quantiles"] for r in exact_quantiles(df, leaf_rows=leaf, pivot_rows=50).collect()}
        assert got[0] == pytest.approx(np.quantile([i for i in range(1000) if i % 3], [0.25, 0.5, 0.75]))
        assert got[1] == pytest.approx(np.quantile(range(0, 1000, 2), [0.25, 0.5, 0.75]))
        assert got.get(2) is None


def test_approximate(spark):
    got = approximate_quantiles(spark.range(10001).selectExpr("cast(id as double) v")).first()["quantiles"]
    assert got == pytest.approx([2500, 5000, 7500], abs=2)


def test_few_pivots_still_end(spark):
    df = spark.range(3000).selectExpr("cast(id * id as double) v")
    got = exact_quantiles(df, leaf_rows=10, pivot_rows=3).first()["quantiles"]
    assert got == pytest.approx(np.quantile(np.arange(3000.0) ** 2, [0.25, 0.5, 0.75]))
