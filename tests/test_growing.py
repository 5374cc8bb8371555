"""Profiles merged from stored sketches against full scans."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tabscope.operators.columns import distinct_stats, missing_stats
from tabscope.plans.growing import DISTINCT_ERROR, RANK_ERROR, grown_profile


def checked(spark, path, store):
    """The grown profile, held against the data itself."""
    found = grown_profile(spark, path, store)
    df = spark.read.option("mergeSchema", True).parquet(path)
    rows = {r["name"]: r for r in found.columns.collect()}
    assert set(rows) == set(df.columns) and found.rows == df.count()
    distinct = {r["name"]: r["unique_count"] for r in distinct_stats(df).collect()}
    for r in missing_stats(df).collect():
        assert (rows[r["name"]]["missing_count"], rows[r["name"]]["missing_pct"]) == (r["missing_count"], r["missing_pct"])
    for name, r in rows.items():
        assert abs(r["unique_count"] - distinct[name]) <= max(1, 4 * DISTINCT_ERROR * distinct[name])
        if r["kind"] == "numeric" and r["mean"] is not None:
            c = F.col(name).cast("double")
            want = df.agg(F.min(c), F.max(c), F.avg(c), F.stddev_samp(c), *[F.avg((c < r[q]).cast("double")) for q in ("q25", "q50", "q75")],
                          *[F.avg((c <= r[q]).cast("double")) for q in ("q25", "q50", "q75")]).first()
            assert (r["min"], r["max"]) == (want[0], want[1])
            assert r["mean"] == pytest.approx(want[2], rel=1e-9) and r["std"] == pytest.approx(want[3], rel=1e-6)
            for target, below, upto in zip((0.25, 0.5, 0.75), want[4:7], want[7:10]):
                assert below - 2 * RANK_ERROR <= target <= upto + 2 * RANK_ERROR
    return found, rows


def test_only_new_files_are_scanned(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("gap", F.when(F.col("l_orderkey") % 3 == 0, F.col("l_tax")))
    lines = lines.select("l_orderkey", "l_extendedprice", "gap", "l_returnflag", "l_shipdate")
    data, store = str(tmp_path / "d"), str(tmp_path / "store")
    a, b = lines.where("l_orderkey % 4 < 3"), lines.where("l_orderkey % 4 = 3")
    a.repartition(3).write.parquet(data)
    first, _ = checked(spark, data, store)
    assert len(first.scanned) == 3
    again, _ = checked(spark, data, store)
    assert again.scanned == []
    before = set(os.listdir(data))
    b.coalesce(1).write.mode("append").parquet(data)
    grown, rows = checked(spark, data, store)
    new = {f for f in set(os.listdir(data)) - before if f.endswith(".parquet")}
    assert {os.path.basename(p) for p in grown.scanned} == new and len(new) == 1
    assert rows["l_shipdate"]["date_min"] is not None
    # another dataset in the same store
    other = str(tmp_path / "other")
    b.write.parquet(other)
    assert checked(spark, other, store)[0].rows == b.count()
    assert grown_profile(spark, data, store).scanned == []


def test_changed_and_removed_files(spark, tmp_path):
    data, store = str(tmp_path / "d"), str(tmp_path / "store")
    spark.range(1_000).selectExpr("id", "cast(id % 7 as string) s").repartition(4).write.parquet(data)
    checked(spark, data, store)
    gone = sorted(f for f in os.listdir(data) if f.endswith(".parquet"))[0]
    spark.range(1_000, 1_100).selectExpr("id", "cast(id as string) s").coalesce(1).write.mode("append").parquet(data)
    grown_profile(spark, data, store)
    os.makedirs(tmp_path / "away")
    shutil.move(os.path.join(data, gone), tmp_path / "away" / gone)
    found, _ = checked(spark, data, store)
    assert len(found.scanned) == 3  # what is left of its increment
    # back again: the first increment is whole, but files of it are in a newer one
    shutil.move(tmp_path / "away" / gone, os.path.join(data, gone))
    checked(spark, data, store)
    assert checked(spark, data, store)[0].scanned == []


def test_new_columns_nulls_and_folders(spark, tmp_path):
    data, store = str(tmp_path / "d"), str(tmp_path / "store")
    spark.range(50).selectExpr("id", "cast(null as double) x", "id % 2 as p").write.partitionBy("p").parquet(data)
    _, rows = checked(spark, data, store)
    assert rows["x"]["missing_pct"] == 100.0 and rows["x"]["q50"] is None and "p" in rows
    spark.range(50, 60).selectExpr("id", "2.5D x", "'new' as y", "id % 2 as p").write.mode("append").partitionBy("p").parquet(data)
    _, rows = checked(spark, data, store)
    assert rows["y"]["missing_count"] == 50 and rows["x"]["q50"] == 2.5
    one = str(tmp_path / "one.parquet")
    spark.range(5).write.parquet(one)
    assert checked(spark, one, store)[0].rows == 5


def test_wrong_calls(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        grown_profile(spark, str(tmp_path / "none"), str(tmp_path / "store"))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "f.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="not a Parquet"):
        grown_profile(spark, str(tmp_path / "c"), str(tmp_path / "store"))
    data, store = str(tmp_path / "d"), str(tmp_path / "store")
    spark.range(5).write.parquet(data)
    grown_profile(spark, data, store)
    spark.range(5).selectExpr("cast(id as string) id").write.mode("append").parquet(data)
    with pytest.raises(Exception, match="different types"):
        grown_profile(spark, data, store)
    (tmp_path / "empty").mkdir()
    assert grown_profile(spark, str(tmp_path / "empty"), store).columns.count() == 0
