"""The monthly trend of a dataset, with columns chosen from its roles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.names import col
from tabscope.operators.classes import BOOLEAN, NUMERIC, TEMPORAL, ColumnInfo, column_infos
from tabscope.operators.coerce import coerce_dates, detect_date_columns
from tabscope.operators.roles import DATE_NAME, ID_NAME, ID_TYPES, REVENUE_NAME
from tabscope.operators.trend import monthly_sum
from tabscope.sources.files import load_dataset, resolve_path

# Numbers that only sound like dates (a year, a day count) are not read as instants.
DATE_TYPES = ("timestamp_ntz", "timestamp", "date", "string")


def frame_trend(df: DataFrame) -> DataFrame | None:
    """``month, total`` of the first revenue (else metric) column over the first date column.

    None if the table has no such pair of columns. Types and names decide as far as they
    can; only what they leave open is looked up, one column at a time: whether a date
    column without a telling name has a value, and whether a long integer is unique.
    """
    typed = coerce_dates(df, detect_date_columns(df))
    date, metric = _date_column(typed), _metric_column(typed)
    return monthly_sum(typed, date, metric) if date and metric else None


def _date_column(df: DataFrame) -> str | None:
    for i in column_infos(df):
        if i.dtype in DATE_TYPES:
            named = re.search(DATE_NAME, i.name)
            if named or (i.kind == TEMPORAL and not df.where(col(i.name).isNotNull()).isEmpty()):
                return i.name
    return None


def _metric_column(df: DataFrame) -> str | None:
    """The first revenue column, else the first number or boolean that is no identifier."""
    numeric = [i for i in column_infos(df) if i.kind in (NUMERIC, BOOLEAN)]
    for i in numeric:
        if re.search(REVENUE_NAME, i.name):
            return i.name
    for i in numeric:
        if not re.search(ID_NAME, i.name) and not (i.dtype in ID_TYPES and _unique(df, i)):
            return i.name
    return None


def _unique(df: DataFrame, info: ColumnInfo) -> bool:
    found = df.agg(F.count("*").alias("rows"), F.count_distinct(info.value).alias("values")).first()
    return 0 < found["values"] == found["rows"]


def dataset_trend(spark: SparkSession, path: str, file_type: str | None = None) -> DataFrame | None:
    return frame_trend(load_dataset(spark, resolve_path(path), file_type))
