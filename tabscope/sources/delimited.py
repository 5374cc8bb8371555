"""CSV scans: one for profiling (many NA tokens) and one for SQL views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StringType, StructField, StructType

from tabscope.functions.names import col
from tabscope.sources.records import fields_in, has_stray_quotes, parse_records, read_records

# The tokens that pandas.read_csv reads as missing by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The spellings that pandas.read_csv reads as booleans.
BOOL_TOKENS = ["True", "TRUE", "true", "False", "FALSE", "false"]

COLUMNS_PER_SCAN = 100

DELIMITERS = [",", "|", ";", "\t"]

INTEGER = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITE = r"^\s*[+-]?([iI]nf|[iI]nfinity|INF|INFINITY)\s*$"


def _as_double(value: Column) -> Column:
    infinite = F.when(F.trim(value).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(value.rlike(INFINITE), infinite).otherwise(F.trim(value).try_cast("double"))


def _outside_quotes(line: Column) -> Column:
    return F.regexp_replace(line, '"[^"]*"', "")


def has_line_breaks(spark: SparkSession, path: str, sep: str, bad_rows: str = "raise") -> bool:
    """Whether quoted values of the files hold line breaks; one pass over their lines.

    A line with an odd number of quotes opens or ends such a value. Without any, the same
    pass counts lines with more fields than the header, which raise a ``ValueError``
    unless ``bad_rows`` is ``cut``; else they are counted by records.
    """
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        raise ValueError(f"No header in CSV file: {path}")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    fields = F.size(F.split(_outside_quotes(F.col("value")), f"[{sep}]"))
    width = fields_of(first[0], sep)
    seen = lines.agg(
        F.count_if(quotes % 2 == 1).alias("odd"), F.count_if(fields > width).alias("wide")
    ).first()
    if seen["odd"]:
        return True
    _refuse(seen["wide"], path, bad_rows)
    return False


def _refuse(wide: int, path: str, bad_rows: str) -> None:
    if wide and bad_rows == "raise":
        raise ValueError(f"{wide} rows of {path} have more fields than the header")


def _options(sep: str) -> dict[str, str]:
    return {"sep": sep, "quote": '"', "escape": '"'}


def _text_columns(spark: SparkSession, path: str, sep: str, bad_rows: str) -> DataFrame:
    """All values as text, of files with line breaks inside quotes; empty ones are null.

    Many tasks read a file, see ``records.py``. Where quotes stand inside unquoted values,
    one task reads each file.
    """
    whole = spark.read.options(**_options(sep)).option("header", True).option("multiLine", True).option("enforceSchema", False)
    names = whole.csv(path).columns
    records = read_records(spark, path)
    heads = records.where("header").select("record").distinct().limit(2).collect()
    if len(heads) > 1:
        raise ValueError(f"part files of {path} have different headers")
    seen = records.agg(
        F.count_if(fields_in(F.col("record"), sep) > len(names)).alias("wide"),
        F.count_if(has_stray_quotes(F.col("record"), sep)).alias("stray"),
    ).first()
    if not seen["stray"]:
        _refuse(seen["wide"], path, bad_rows)
        return parse_records(records, names, _options(sep))
    more = StructType([StructField(f"c{i}", StringType()) for i in range(len(names) + 1)])
    rows = whole.option("enforceSchema", True).schema(more).csv(path)
    _refuse(rows.where(F.col(f"c{len(names)}").isNotNull()).count(), path, bad_rows)
    return rows.select([F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def fields_of(line: str, sep: str) -> int:
    return re.sub('"[^"]*"', "", line).count(sep) + 1


def read_profile_csv(
    spark: SparkSession, path: str, sep: str = ",", multiline: bool | None = None, bad_rows: str = "raise"
) -> DataFrame:
    """Header CSV with NA tokens nulled *before* the types are inferred.

    Spark's reader takes a single null token, so the file is scanned as text
    columns, and aggregates over the columns find which are boolean, integer
    or floating. Dates stay text here; date coercion is a later operator.
    Line breaks inside quotes are found in the data, and such files still split;
    ``multiline`` says so beforehand and leaves them to Spark's reader, one task a file.
    Rows with more fields than the header raise a ``ValueError`` unless ``bad_rows`` is
    ``cut``. Part files with another header raise an error.
    """
    if multiline is None and has_line_breaks(spark, path, sep, bad_rows):
        raw = _text_columns(spark, path, sep, bad_rows)
    else:
        raw = _plain_columns(spark, path, sep, bool(multiline))
    text = raw.select([F.when(~col(c).isin(NA_TOKENS), col(c)).alias(c) for c in raw.columns])
    return _cast_inferred(text)


def _plain_columns(spark: SparkSession, path: str, sep: str, multiline: bool) -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def _tests(i: int, value: Column) -> list[Column]:
    whole = value.rlike(INTEGER)
    return [
        F.count(value).alias(f"n{i}"),
        F.count_if(value.isin(BOOL_TOKENS)).alias(f"b{i}"),
        F.count_if(whole).alias(f"w{i}"),
        F.count_if(whole & F.trim(value).try_cast("bigint").isNotNull()).alias(f"i{i}"),
        F.count_if(whole & F.trim(value).try_cast("decimal(38,0)").isNotNull()).alias(f"k{i}"),
        F.count_if(value.rlike(DECIMAL) | value.rlike(INFINITE)).alias(f"d{i}"),
    ]


def _cast_inferred(text: DataFrame) -> DataFrame:
    found: dict[str, int] = {}
    places = list(enumerate(text.columns))
    for start in range(0, len(places), COLUMNS_PER_SCAN):
        checks = [c for i, name in places[start : start + COLUMNS_PER_SCAN] for c in _tests(i, col(name))]
        found |= text.agg(*checks).first().asDict()
    typed = []
    for i, name in enumerate(text.columns):
        n, value = found[f"n{i}"], col(name)
        if n == 0:
            typed.append(value.cast("double").alias(name))  # all missing: pandas gives float64
        elif found[f"b{i}"] == n:
            typed.append((F.lower(value) == "true").alias(name))
        elif found[f"i{i}"] == n:
            typed.append(F.trim(value).cast("bigint").alias(name))
        elif found[f"w{i}"] == n:  # whole numbers keep all their digits: exact decimals, else text
            typed.append((F.trim(value).cast("decimal(38,0)") if found[f"k{i}"] == n else value).alias(name))
        elif found[f"d{i}"] == n:
            typed.append(_as_double(value).alias(name))
        else:
            typed.append(value.alias(name))
    return text.select(typed)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that occurs most often in the header line, outside quotes."""
    header = spark.read.text(path).first()
    line = re.sub('"[^"]*"', "", header[0]) if header else ""
    return max(DELIMITERS, key=line.count) if any(d in line for d in DELIMITERS) else ","


def read_sql_csv(
    spark: SparkSession, path: str, sep: str | None = None, schema: str | None = None, bad_rows: str = "raise"
) -> DataFrame:
    """Header CSV for a SQL view: sniffed delimiter, inferred types, only empty is null.

    A given ``schema`` spares the pass that infers one. Whole numbers beyond 64 bits are
    decimals where Spark infers decimals for them, else text.
    """
    sep = sep or sniff_delimiter(spark, path)
    if has_line_breaks(spark, path, sep, bad_rows):
        text = _text_columns(spark, path, sep, bad_rows)
        kinds = [f.dataType.simpleString() for f in StructType.fromDDL(schema)] if schema else _sql_types(text)
        names = [f.name for f in StructType.fromDDL(schema)] if schema else text.columns
        return text.select([col(c).try_cast(kind).alias(n) for c, kind, n in zip(text.columns, kinds, names)])
    reader = (
        spark.read.option("header", True)
        .options(**_options(sep))
        .option("nullValue", "")
        .option("nanValue", "nan")
        .option("enforceSchema", False)
    )
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


#: The types that Spark infers for CSV columns, in its order, and how their values are written.
SQL_TYPES = [
    ("int", r"^[+-]?[0-9]+$"),
    ("bigint", r"^[+-]?[0-9]+$"),
    ("decimal(38,0)", r"^[+-]?[0-9]+$"),
    ("double", r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|nan|[+-]?(Inf|Infinity))$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}.*$"),
    ("boolean", r"^(?i)(true|false)$"),
]


def _sql_types(text: DataFrame) -> list[str]:
    """The type of each text column: the first that all its values can be."""
    found: dict[str, int] = {}
    places = list(enumerate(text.columns))
    for start in range(0, len(places), COLUMNS_PER_SCAN):
        checks = []
        for i, name in places[start : start + COLUMNS_PER_SCAN]:
            checks.append(F.count(col(name)).alias(f"n{i}"))
            for k, (kind, pattern) in enumerate(SQL_TYPES):
                checks.append(F.count_if(col(name).rlike(pattern) & col(name).try_cast(kind).isNotNull()).alias(f"t{i}_{k}"))
        found |= text.agg(*checks).first().asDict()
    kinds = []
    for i, _ in places:
        fits = [kind for k, (kind, _) in enumerate(SQL_TYPES) if found[f"n{i}"] and found[f"t{i}_{k}"] == found[f"n{i}"]]
        kinds.append(fits[0] if fits else "string")
    return kinds
