"""Date coercion: text columns whose first values read as dates become timestamps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.dates import parse_date
from tabscope.functions.names import col

SAMPLE_VALUES = 20
MIN_PARSED = 0.8
HEAD_ROWS = 1000


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def file_position(df: DataFrame) -> list[Column]:
    """Sort keys that put rows in file order; empty when rows have no file behind them."""
    try:
        fields = df.select("_metadata").schema[0].dataType.names
    except AnalysisException:
        return []
    if "row_index" in fields:
        return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]


def in_files(df: DataFrame, files: list[str]) -> DataFrame:
    """Rows of some input files. The filter prunes all other files from the scan."""
    # A local path is written file:///x in a file list and file:/x in the metadata.
    names = [name for f in files for name in (f, f.replace("file:///", "file:/"))]
    return df.where(F.col("_metadata.file_path").isin(names))


def first_rows(df: DataFrame, n: int, files: int = 1) -> DataFrame:
    """The first n rows in file order as far as the first few files hold them."""
    head = in_files(df, sorted(df.inputFiles())[:files])
    position = file_position(df)
    if len(position) == 2:  # rows know their index: no file gives more than its first n
        head = head.where(F.col("_metadata.row_index") < n)
    return head.orderBy(*position).limit(n)


def detect_date_columns(df: DataFrame, order_by: list | None = None) -> list[str]:
    """Text columns of which at least 80% of the first 20 values read as dates.

    ``order_by`` says what "first" means; by default it is file order. Rows from
    the head of the first file then settle most columns; a full pass follows only
    for columns with too few values there.
    """
    names = text_columns(df)
    passed: list[str] = []
    unsettled = names
    if names and order_by is None:
        order_by = file_position(df)
        if order_by:
            passed, unsettled = _vote(df, names, order_by, final=False)
        else:
            order_by = [F.monotonically_increasing_id()]
    if unsettled:
        passed += _vote(df, unsettled, order_by, final=True)[0]
    return [n for n in names if n in passed]


def _vote(df: DataFrame, names: list[str], order_by: list, final: bool) -> tuple[list[str], list[str]]:
    """Columns that pass, and columns without enough sample values to tell."""
    keys = [k.alias(f"_k{i}") if not isinstance(k, str) else col(k).alias(f"_k{i}") for i, k in enumerate(order_by)]
    key_names = [f"_k{i}" for i in range(len(keys))]
    narrow = (df if final else first_rows(df, HEAD_ROWS)).select(*keys, *[col(n).alias(f"v{i}") for i, n in enumerate(names)])
    pairs = ", ".join(f"{i}, v{i}" for i in range(len(names)))
    order = W.partitionBy("i").orderBy(*key_names)
    # row_number() <= constant: each task keeps 20 rows per column before the shuffle.
    sample = (
        narrow.selectExpr(*key_names, f"stack({len(names)}, {pairs}) as (i, value)")
        .where(F.col("value").isNotNull())
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= SAMPLE_VALUES)
    )
    votes = {
        r["i"]: (r["n"], r["parsed"])
        for r in sample.groupBy("i")
        .agg(F.count("*").alias("n"), F.count(parse_date(F.col("value"))).alias("parsed"))
        .collect()
    }
    passed, unsettled = [], []
    for i, name in enumerate(names):
        n, parsed = votes.get(i, (0, 0))
        if not final and n < SAMPLE_VALUES:
            unsettled.append(name)
        elif n and parsed / n >= MIN_PARSED:
            passed.append(name)
    return passed, unsettled


def coerce_dates(df: DataFrame, names: list[str]) -> DataFrame:
    """Parse the named text columns; values that are no date become null."""
    return df.select([parse_date(col(c)).alias(c) if c in names else col(c) for c in df.columns])
