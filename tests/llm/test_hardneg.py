"""Hard negatives against brute force in whole numbers."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscope.llm import hardneg
from tabscope.llm.queries import QUERIES

SCHEMA = "vec_id long, label int, embedding array<double>"


def usable(rows):
    out = []
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            out.append((i, label, [int(np.floor(256 * x)) for x in v]))
    return out


def brute(rows, is_anchor, mining=hardneg.Mining()):
    rows, out = usable(rows), []
    for i, label, v in rows:
        if not is_anchor(i):
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(v, w)), hardneg.LOW), hardneg.HIGH), j, m) for j, m, w in rows if j != i and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scored if s[2] == label)[: mining.positives]:
            inside = sorted(s for s in scored if s[2] != label and -mining.least * p <= -100 * s[0] <= -mining.most * p)
            out += [(i, positive, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(inside[: mining.negatives])]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", cell string, row int").repartition(3)
    return hardneg.mine(frame, F.col("vec_id") % 50 == 0, **more)


def odd_rows(rng, dims):
    rows = [(int(i), int(rng.integers(0, 4)), [float(x) for x in rng.normal(size=dims) * 0.3 + 0.1]) for i in range(250)]
    copy = rows[7][2]
    rows += [(250 + i, int(i % 4), copy) for i in range(120)]  # ties
    rows += [(50, 1, rows[3][2]), (7, 2, copy), (7, 2, copy)]  # repeated ids
    rows += [(400, None, copy), (401, 1, None), (402, 1, []), (403, 1, [None] * dims), (404, 1, [float("nan")] * dims)]
    rows += [(405, 1, [float("inf")] * dims), (None, 1, copy), (450, 2, [1.0]), (451, 2, [2.0]), (452, 3, [1.9]), (500, 1, [-1e-20] * dims)]
    return rows


@pytest.mark.parametrize("dims", [3, 20])
@pytest.mark.parametrize("slices", [(65_536, 4_096), (40, 3)])
def test_brute_force(spark, monkeypatch, dims, slices):
    monkeypatch.setattr(hardneg, "CANDIDATE_SLICE", slices[0])
    monkeypatch.setattr(hardneg, "ANCHOR_SLICE", slices[1])
    rows = odd_rows(np.random.default_rng(dims), dims)
    assert sorted(map(tuple, mined(spark, rows).collect())) == brute(rows, lambda i: i % 50 == 0)
    few = hardneg.Mining(positives=2, negatives=1, least=10, most=90)
    assert sorted(map(tuple, mined(spark, rows, mining=few).collect())) == brute(rows, lambda i: i % 50 == 0, few)


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = odd_rows(rng, 6)
    rows += [(600 + i, int(i % 4), [float(x) for x in rng.normal(size=6) * 10.0 ** int(rng.integers(0, 30))]) for i in range(60)]
    assert sorted(map(tuple, mined(spark, rows).collect())) == brute(rows, lambda i: i % 50 == 0)


def test_an_outlier_does_not_slow_the_others():
    rng = np.random.default_rng(6)
    numbers = np.floor(rng.normal(size=(64, 65_536)) * 256)
    numbers[:, 5] = 1e18
    ids = np.arange(65_536)
    part = hardneg._slice(ids, ids % 10, numbers)
    assert part.large.sum() == 1 and np.abs(part.low).max() < 1e6
    began = time.monotonic()
    for j in range(20, 40):
        found = hardneg.positives_of(numbers[:, j], j, part, 5, False)
        scores = numbers.T @ numbers[:, j]
        scores[j] = -np.inf
        assert [i for _, i in found] == np.argsort(-scores, kind="stable")[:5].tolist()
    assert time.monotonic() - began < 10


@settings(max_examples=200, deadline=None)
@given(st.integers(-1_000, 1_000), st.integers(-1_000, 1_000))
def test_windows(score, other):
    low, high = hardneg.window(score, hardneg.Mining())
    assert (low <= other <= high) == (50 * score <= 100 * other <= 95 * score)


def test_scans_read_by_magnitude_and_drop_candidates():
    rng = np.random.default_rng(7)
    numbers = np.floor(rng.normal(size=(32, 2_000)) * 256)
    anchor = np.zeros(32)
    anchor[[30, 4]] = 500, -900  # all of the score lies in two dimensions
    part = hardneg._slice(np.arange(2_000), np.zeros(2_000), numbers)
    seen = []

    def shrink(scores, least, most):
        seen.append((len(scores), least, most))
        return scores + most >= np.sort(scores)[-3] + least

    at, scores = hardneg.scan(anchor, part, np.ones(2_000, bool), shrink)
    assert seen[0][1:] == (0.0, 0.0) and seen[1][0] == 3  # resolved after the first block
    assert sorted(at) == sorted(np.argsort(-(anchor @ numbers))[:3])
    assert scores.tolist() == (anchor @ numbers)[at].tolist()


def test_nothing_to_mine(spark):
    assert mined(spark, [(1, 1, [1.0])]).count() == 0
    assert hardneg.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    assert mined(spark, [(50, 1, [1.0]), (51, 2, [0.9])]).count() == 0


def test_every_column_can_be_read_alone(spark, sf_dir):
    table = QUERIES["op12_hard_negatives"](spark, sf_dir)
    rows = table.collect()
    assert rows and table.count() == len(rows)
    for c in table.columns:
        assert sorted(r[c] for r in table.select(c).collect()) == sorted(r[c] for r in rows)


def test_slices_by_length():
    ids, labels = pa.array([1, 2, 3]), pa.array([0, 1, 0])
    found = hardneg.slices(ids, labels, pa.array([[1.0, 2.0], [5.0], [3.0, 4.0]]))
    assert found[2][0].numbers.tolist() == [[1.0, 3.0], [2.0, 4.0]] and found[2][1].tolist() == [0, 2]
    assert found[1][0].ids.tolist() == [2]
