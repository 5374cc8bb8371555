from __future__ import annotations

import datetime
import decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscope import compact_profile, inspect_dataset, profile_dataset, profile_frame
from tabscope.operators.coerce import coerce_dates, detect_date_columns
from tabscope.operators.columns import distinct_stats, missing_stats, numeric_stats, top_values
from tabscope.operators.duplicates import duplicate_count
from tabscope.operators.privacy import sample_rows
from tabscope.plans.profile import profile_columns
from tabscope.sources.files import detect_file_type, load_dataset


def columns_of(profile) -> dict:
    return {c["name"]: c for c in profile.first()["columns"]}


def write(path, text: str) -> str:
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_sales_csv(spark, tmp_path):
    lines = ["date,region,product,units,revenue"]
    for i in range(30):
        lines.append(f"2024-0{i % 3 + 1}-1{i % 9},{['North', 'South', 'East'][i % 3]},P{i % 4},{i % 5},{100.5 + i}")
    profile = profile_dataset(spark, write(tmp_path / "sales.csv", "\n".join(lines)))
    row = profile.first()
    assert (row["row_count"], row["column_count"], row["file_type"]) == (30, 5, "csv")
    assert row["file_size_bytes"] == len("\n".join(lines))
    assert row["date_columns"] == ["date"]
    assert row["revenue_columns"] == ["revenue"] and "revenue" in row["metric_columns"]
    assert row["dimension_columns"] == ["region", "product"]
    assert row["sample_rows"] is None
    assert columns_of(profile)["date"]["date_min"] == "2024-01-10 00:00:00"


def test_staged_copy_gives_the_same_profile(spark, tmp_path):
    text = "a.b,day,v\n1,2024-01-01,x\n2,2024-01-02,NA\n2,2024-01-02,NA\n"
    path = write(tmp_path / "st.csv", text)
    plain, staged = (profile_dataset(spark, path, stage=s, include_sample=True).drop("profiled_at").first() for s in (False, True))
    assert plain == staged and staged["duplicate_count"] == 1 and len(staged["sample_rows"]) == 3


def test_missing_values(spark, tmp_path):
    profile = profile_dataset(spark, write(tmp_path / "missing.csv", "a,b\n1.0,x\n,y\n3.0,\n"))
    found = columns_of(profile)
    assert found["a"]["missing_count"] == 1 and found["b"]["missing_count"] == 1
    assert found["a"]["missing_pct"] == 33.33
    assert [(t["value"], t["count"]) for t in found["b"]["top_values"]] == [("None", 1), ("x", 1), ("y", 1)]


def test_date_detection(spark, tmp_path):
    text = "order_date,amount\n2024-01-01,10\n2024-02-01,20\n2024-03-01,30\n"
    found = columns_of(profile_dataset(spark, write(tmp_path / "dates.csv", text)))
    assert found["order_date"]["dtype"] == "timestamp_ntz"
    assert found["order_date"]["date_min"] == "2024-01-01 00:00:00"
    assert found["amount"]["dtype"] == "bigint"


def test_detect_file_type():
    assert detect_file_type("a/B.CSV") == "csv"
    assert detect_file_type("a/part.parquet/") == "parquet"
    assert detect_file_type("a.xlsx") == "excel" and detect_file_type("a.xls") == "excel"
    with pytest.raises(ValueError, match="Unsupported file type: .txt"):
        detect_file_type("a.txt")


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        profile_dataset(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(ValueError, match="excel"):
        load_dataset(spark, "book.xlsx")


def test_inspect(spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    spark.range(2).selectExpr("id as x", "'2024-01-01' as d").write.parquet(path)
    rows = [tuple(r) for r in inspect_dataset(spark, path).collect()]
    assert rows == [(0, "x", "bigint", 2), (1, "d", "string", 2)]  # no date coercion here


EDGE_SCHEMA = (
    "flag boolean, f double, dec decimal(10,2), arr array<int>, m map<string,int>, s struct<a:int>,"
    " bin binary, day date, ts timestamp, nothing string, one int"
)
EDGE_ROWS = [
    (True, 1.5, decimal.Decimal("1.10"), [1, 2], {"a": 1}, (1,), b"x", datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5), None, 7),
    (False, float("nan"), decimal.Decimal("2.20"), [1, 2], {"a": 1}, (2,), b"y", None, datetime.datetime(2024, 1, 2, 3, 4, 5, 60), None, 7),
    (True, None, None, [], {}, None, None, datetime.date(2023, 1, 2), None, None, 7),
    (True, 1.5, decimal.Decimal("1.10"), [1, 2], {"a": 1}, (1,), b"x", datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5), None, 7),
]


def test_edge_types(spark):
    profile = profile_frame(spark.createDataFrame(EDGE_ROWS, EDGE_SCHEMA))
    row, found = profile.first(), columns_of(profile)
    assert row["duplicate_count"] == 1
    assert found["flag"]["kind"] == "boolean" and found["flag"]["mean"] is None and found["flag"]["unique_count"] == 2
    assert found["f"]["missing_count"] == 2 and found["f"]["std"] == 0.0 and found["f"]["unique_count"] == 1
    assert found["dec"]["kind"] == "numeric" and found["dec"]["q50"] == 1.1 and found["dec"]["unique_count"] == 2
    assert found["arr"]["unique_count"] == 2 and found["m"]["unique_count"] == 2 and found["s"]["unique_count"] == 2
    assert found["arr"]["top_values"][0]["value"] == "[1,2]" and found["arr"]["top_values"][0]["count"] == 3
    assert found["day"]["date_min"] == "2023-01-02 00:00:00"
    assert found["ts"]["date_max"] == "2024-01-02 03:04:05.000060" and found["ts"]["unique_count"] == 2
    assert found["nothing"]["unique_count"] == 0 and found["nothing"]["missing_pct"] == 100.0
    assert row["quality_warnings"] == [
        "Column 'f' has only one unique value",
        "Column 'nothing' has 100.0% missing values",
        "Column 'one' has only one unique value",
        "Found 1 duplicate rows",
    ]


def test_empty_and_one_row(spark):
    empty = spark.createDataFrame([], "a bigint, b string, d timestamp_ntz")
    row = profile_frame(empty).first()
    assert row["row_count"] == 0 and row["duplicate_count"] == 0 and row["quality_warnings"] == []
    assert [c["missing_pct"] for c in row["columns"]] == [0.0, 0.0, 0.0]
    assert [c["unique_count"] for c in row["columns"]] == [0, 0, 0]
    one = columns_of(profile_frame(spark.createDataFrame([(5, "x")], "a bigint, b string")))
    assert one["a"]["std"] is None and one["a"]["q25"] == 5.0


def test_wide_table(spark):
    df = spark.range(3).select("id", *[(F.col("id") * i % 3).alias(f"c{i}") for i in range(130)])
    stats, rows = profile_columns(df)
    assert rows == 3 and stats.count() == 131
    assert stats.where("missing_count = 0 and unique_count > 0 and q50 is not null").count() == 131


def test_approximate_profile(spark):
    df = spark.range(2000).selectExpr("id", "cast(id % 10 as double) v", "concat('t', id % 3) t", "true flag")
    found = columns_of(profile_frame(df, approximate=True))
    assert found["v"]["unique_count"] == 10 and found["t"]["unique_count"] == 3 and found["flag"]["unique_count"] == 1
    assert found["id"]["unique_count"] == pytest.approx(2000, rel=0.1) and found["id"]["q50"] == pytest.approx(1000, abs=5)
    assert found["flag"]["q50"] is None and found["t"]["top_values"][0]["count"] == 667


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x")], "`a.b c` bigint, `t``k` string")
    profile = profile_frame(df)
    assert set(columns_of(profile)) == {"a.b c", "t`k"}
    assert profile.first()["id_columns"] == ["a.b c"]


def test_compact_profile(spark):
    df = spark.createDataFrame([(None, "x")] * 3, "a string, b string")
    row = compact_profile(profile_frame(df), max_warnings=2).first()
    assert row["columns"][0].asDict() == {"name": "a", "dtype": "string", "missing_pct": 100.0}
    assert len(row["quality_warnings"]) == 2
    assert "sample_rows" not in row.asDict()


def test_sample_rows(spark, tmp_path):
    path = str(tmp_path / "s.parquet")
    rows = [(i, f"user{i}@example.com", None if i == 1 else "x") for i in range(20)]
    spark.createDataFrame(rows, "i int, mail string, n string").coalesce(1).write.parquet(path)
    got = sample_rows(spark.read.parquet(path), 3).collect()
    assert [tuple(r) for r in got] == [(str(i), "[REDACTED_EMAIL]", None if i == 1 else "x") for i in range(3)]
    many = str(tmp_path / "many.parquet")
    spark.range(40).repartition(20).write.parquet(many)
    assert sample_rows(spark.read.parquet(many), 39, redact=False).count() == 39
    assert sample_rows(spark.range(9), 4, redact=False).count() == 4


def test_date_coercion_threshold(spark):
    def dates(bad: int):
        values = ["nope"] * bad + [f"2024-01-{d:02d}" for d in range(1, 21 - bad)] + ["10:30"] * 5
        return spark.createDataFrame(list(enumerate(values)), "i int, d string")

    assert detect_date_columns(dates(4), order_by=["i"]) == ["d"]
    assert detect_date_columns(dates(5), order_by=["i"]) == []
    typed = coerce_dates(dates(4), ["d"])
    assert missing_stats(typed).where("name = 'd'").first()["missing_count"] == 9


def test_date_coercion_looks_past_leading_nulls(spark, tmp_path):
    path = str(tmp_path / "late.parquet")
    rows = [(i, None if i < 3000 else "2024-05-06") for i in range(3030)]
    spark.createDataFrame(rows, "i int, d string").coalesce(1).write.parquet(path)
    assert detect_date_columns(spark.read.parquet(path)) == ["d"]
    empty = spark.createDataFrame([(None,)], "d string")
    assert detect_date_columns(empty) == []


WRITTEN = {
    "2024-03-05": "2024-03-05 00:00:00",
    "2024-03-05T06:07:08Z": "2024-03-05 06:07:08",
    "2024-03-05 06:07:08.250+02:00": "2024-03-05 04:07:08.25",
    "2024-03-05 06:07:08+0200": "2024-03-05 04:07:08",
    "2024-03": "2024-03-01 00:00:00",
    "2024/3/5": "2024-03-05 00:00:00",
    "3/5/2024": "2024-03-05 00:00:00",
    "25/12/2024": "2024-12-25 00:00:00",
    "5 Mar 2024": "2024-03-05 00:00:00",
    "March 5, 2024": "2024-03-05 00:00:00",
    "mar 5 2024": "2024-03-05 00:00:00",
    "5-Mar-2024": "2024-03-05 00:00:00",
    "20240305": "2024-03-05 00:00:00",
    "2024": "2024-01-01 00:00:00",
    " 2024-03-05 ": "2024-03-05 00:00:00",
    "10:30": None,
    "now": None,
    "2024-13-45": None,
    "13/13/2024": None,
    "abc": None,
    "": None,
}


def test_written_dates(spark):
    df = spark.createDataFrame([(k,) for k in WRITTEN], "d string")
    got = [r[0] for r in coerce_dates(df, ["d"]).selectExpr("cast(d as string)").collect()]
    assert dict(zip(WRITTEN, got)) == WRITTEN


def brute_duplicates(rows) -> int:
    return len(rows) - len({repr(r) for r in rows})


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_duplicates_with_a_hot_row(spark, limit):
    rows = [(1, "x", None)] * 400 + [(i, "y", float(i % 7)) for i in range(600)] + [(5, "y", 5.0)]
    df = spark.createDataFrame(rows, "a int, b string, c double").repartition(8)
    threshold = "spark.sql.autoBroadcastJoinThreshold"  # either join must give the same count
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, limit)
    try:
        assert duplicate_count(df).first()[0] == brute_duplicates(rows)
    finally:
        spark.conf.set(threshold, before)
    assert duplicate_count(df.dropDuplicates()).first()[0] == 0


def test_long_texts(spark):
    head = "h" * 64
    rows = [(head + "a",)] * 3 + [(head + "b",)] * 2 + [(head,)] * 2 + [("None",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    assert distinct_stats(df).first()["unique_count"] == 4
    got = [(r["value"], r["count"]) for r in top_values(df).orderBy("rank").collect()]
    assert got == [(head + "a", 3), ("None", 2), (head, 2), (head + "b", 2)]


cell = st.tuples(
    st.one_of(st.none(), st.integers(-5, 5)),
    st.one_of(st.none(), st.floats(allow_nan=True, allow_infinity=False, width=32)),
    st.one_of(st.none(), st.sampled_from(["a", "b", "é", "x" * 70, "x" * 70 + "y"])),
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(cell, min_size=1, max_size=40))
def test_statistics_match_pandas(spark, rows):
    import pandas as pd

    df = spark.createDataFrame(rows, "i bigint, f double, s string")
    frame = pd.DataFrame(rows, columns=["i", "f", "s"])
    frame["i"] = pd.to_numeric(frame["i"])
    frame["f"] = pd.to_numeric(frame["f"])
    missing = {r["name"]: r["missing_count"] for r in missing_stats(df).collect()}
    assert missing == {c: int(frame[c].isna().sum()) for c in frame}
    distinct = {r["name"]: r["unique_count"] for r in distinct_stats(df).collect()}
    assert distinct == {c: int(frame[c].nunique()) for c in frame}
    for r in numeric_stats(df).collect():
        want = frame[r["name"]].astype("float64").describe()
        for ours, theirs in (("min", "min"), ("max", "max"), ("mean", "mean"), ("std", "std"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%")):
            if pd.isna(want[theirs]):
                assert r[ours] is None
            else:
                assert r[ours] == pytest.approx(want[theirs], rel=1e-9, abs=1e-6)
    counts = frame["s"].map(lambda v: "None" if v is None else v).value_counts()
    best = {r["value"]: r["count"] for r in top_values(df).collect()}
    assert sum(best.values()) == counts.head(5).sum() and all(counts[v] == n for v, n in best.items())


def test_ties_of_long_texts_go_by_value(spark):
    """Texts that share 64 and more characters, in order of value whatever their digests."""
    head, long = "h" * 64, "h" * 64 + "x" * 1_000
    texts = [head + c for c in "hgfedcba"]
    assert [r["value"] for r in top_values(spark.createDataFrame([(t,) for t in texts], "t string"), 5).orderBy("rank").collect()] == sorted(texts)[:5]
    texts += [head, long + "b", long + "a", long, long + "é", long + "zz"] * 2 + ["short"] * 3 + [long + "twice"] * 2
    texts += [long + "y" * 200 + str(i % 7) for i in range(14)] + [None, None]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int").repartition(5)
    counts = {}
    for t in texts:
        counts["None" if t is None else t] = counts.get("None" if t is None else t, 0) + 1
    want = sorted(counts.items(), key=lambda p: (-p[1], p[0].encode()))
    for k in (1, 3, 5, 9, 14, 40):
        got = [(r["value"], r["count"]) for r in top_values(df.select("t"), k).orderBy("rank").collect()]
        assert got == want[:k]
