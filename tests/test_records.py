"""CSV with quoted line breaks, cut into many splits, against Spark's reader of whole files."""

from __future__ import annotations

import csv
import random

import pytest

from tabscope.sources.delimited import read_profile_csv, read_sql_csv
from tabscope.sources.records import read_records


@pytest.fixture
def split_bytes(spark):
    """Sets the size of file splits."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def put(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield put
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def value(rng):
    return "".join(rng.choices(['"', "\n", ",", "a", "bc", " ", "é", "\r\n", "12", ""], k=rng.randrange(8)))


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(rows)


@pytest.mark.parametrize("size", [7, 60, 1_000, 10**8])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_of_any_split(spark, tmp_path, split_bytes, size, end):
    rng = random.Random(size)
    rows = [["id", "a\nb", "c"]] + [[str(i), value(rng), value(rng)] for i in range(150 if size > 7 else 30)]
    rows.insert(20, ["x", "\n" * (5 * size % 1_000) + 'long "quoted" value' + "\n,\n" * 20, "y"])
    write(tmp_path / "f.csv", rows, end)
    split_bytes(size)
    got = read_records(spark, str(tmp_path / "f.csv"))
    if size <= 1_000:
        assert got.rdd.getNumPartitions() > 3
    found = got.collect()
    assert sorted(next(csv.reader([r.record], strict=True)) if "\n" not in r.record else next(csv.reader(r.record.splitlines(True))) for r in found if r.record) == sorted(
        rows
    )
    assert [r.record for r in found if r.header] == ['id,"a\nb",c']


@pytest.mark.parametrize("read", [read_profile_csv, read_sql_csv])
def test_split_files_equal_whole_ones(spark, tmp_path, split_bytes, read):
    rng = random.Random(4)
    text = lambda: "".join(rng.choices(["\n", ",", "a", "bc", '"q"', " x", "é"], k=rng.randrange(1, 9)))
    rows = [["n", "t", "d", "f", "b", "e"]]
    rows += [[str(i), text(), f"2024-01-{1 + i % 28:02}", str(i / 4), ("true", "false")[i % 2], ""] for i in range(400)]
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "1.csv", rows)
    write(tmp_path / "d" / "2.csv", rows[:1] + rows[1:50])
    split_bytes(500)
    got = read(spark, str(tmp_path / "d"))
    whole = spark.read.options(header=True, quote='"', escape='"', multiLine=True, inferSchema=True, nullValue="").csv(str(tmp_path / "d"))
    assert [tuple(map(str, r)) for r in got.select("n", "t", "f", "b", "e").orderBy("n", "t").collect()] == [
        tuple(map(str, r)) for r in whole.select("n", "t", "f", "b", "e").orderBy("n", "t").collect()
    ]
    if read is read_sql_csv:
        assert got.dtypes == whole.dtypes
        assert read(spark, str(tmp_path / "d"), schema="n long, t string, d date, f double, b boolean, e string").schema[0].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("read", [read_profile_csv, read_sql_csv])
def test_surplus_fields_next_to_line_breaks(spark, tmp_path, read):
    file = tmp_path / "w.csv"
    file.write_text('a,b\n1,"x\ny"\n3,4,5\n6,7,\n', encoding="utf-8")
    with pytest.raises(ValueError, match="^2 rows of .* more fields"):
        read(spark, str(file))
    rows = read(spark, str(file), bad_rows="cut").orderBy("a").collect()
    assert [tuple(map(str, r)) for r in rows] == [("1", "x\ny"), ("3", "4"), ("6", "7")]


@pytest.mark.parametrize("read", [read_profile_csv, read_sql_csv])
def test_quotes_inside_unquoted_values(spark, tmp_path, read):
    file = tmp_path / "q.csv"
    file.write_text('a,b\n5" pipe,1\n6,2\n7" pipe,"x\ny"\n8 8" a 9" b,4\n', encoding="utf-8")
    want = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(file)).collect()
    assert sorted(map(tuple, read(spark, str(file)).collect())) == sorted(map(tuple, want))
    file.write_text('a,b\n5" pipe,1\n6,2,3\n', encoding="utf-8")
    with pytest.raises(ValueError, match="more fields"):
        read(spark, str(file))


def test_part_files_with_another_header(spark, tmp_path):
    for name, head in (("1.csv", "a,b"), ("2.csv", "b,a")):
        (tmp_path / name).write_text(f'{head}\n1,"x\ny"\n', encoding="utf-8")
    with pytest.raises(ValueError, match="different headers"):
        read_sql_csv(spark, str(tmp_path))
