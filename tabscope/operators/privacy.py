"""Redaction of rows and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabscope.functions.names import col
from tabscope.functions.text import pii_counts, redact_text
from tabscope.operators.classes import column_infos
from tabscope.operators.coerce import file_position, first_rows

HEAD_FILES = 16


def redact_rows(df: DataFrame) -> DataFrame:
    """Every value as redacted text; null stays null."""
    return df.select([redact_text(i.text).alias(i.name) for i in column_infos(df)])


def with_pii_counts(df: DataFrame, text_column: str) -> DataFrame:
    """Add ``email, phone, ssn, cc`` replacement counts for one text column."""
    return df.withColumns(pii_counts(col(text_column)))


def sample_rows(df: DataFrame, n: int = 5, redact: bool = True, order_by: list | None = None) -> DataFrame:
    """The first n rows in file order (or by ``order_by``), redacted by default.

    The first few files usually hold enough rows and then only they are read.
    Redaction follows the limit.
    """
    if order_by is not None:
        first = df.orderBy(*order_by).limit(n)
    elif not file_position(df):
        first = df.limit(n)
    elif first_rows(df, n, HEAD_FILES).count() == n:
        first = first_rows(df, n, HEAD_FILES)
    else:
        first = df.orderBy(*file_position(df)).limit(n)
    return redact_rows(first) if redact else first
