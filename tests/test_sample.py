"""Samples of an exact size."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tabscope.operators.sample import SEPARATOR, exact_sample


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(5_000).selectExpr("id", "if(id % 10 = 0, null, cast(id % 97 as string)) s", "map('k', id) m")


def plain(ids, n, seed):
    text = lambda i: SEPARATOR.join([str(seed), str(i), SEPARATOR if i % 10 == 0 else str(i % 97)])
    return sorted(sorted(ids, key=lambda i: hashlib.md5(text(i).encode()).hexdigest())[:n])


@pytest.mark.parametrize("n", [0, 1, 137, 4_999, 5_000, 9_000])
def test_size_and_rule(rows, n):
    got = sorted(r.id for r in exact_sample(rows, n, 3, ["id", "s"]).collect())
    assert got == plain(range(5_000), n, 3)


def test_partitioning_does_not_matter(rows):
    want = sorted(r.id for r in exact_sample(rows, 200, 1, ["id"]).collect())
    for parts in (1, 13):
        assert sorted(r.id for r in exact_sample(rows.repartition(parts, F.rand(parts)), 200, 1, ["id"]).collect()) == want
    assert sorted(r.id for r in exact_sample(rows, 200, 2, ["id"]).collect()) != want


def test_equal_keys_and_copies(spark):
    same = spark.range(1_000).selectExpr("1 as k", "id % 4 as v")
    got = exact_sample(same, 10, keys=["k"]).collect()
    assert [r.v for r in got] == [0] * 10  # one hash: the other columns decide
    assert exact_sample(same, 3).count() == 3
    assert exact_sample(same.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        exact_sample(same, -1)
