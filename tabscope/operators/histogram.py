"""Value histograms: one shuffle of (column, value) that serves several statistics.

Rows are spread over columns with ``stack`` and counted by value. Equal values
collapse before the shuffle, so a value that holds a third of all rows is one
record per task. Text longer than ``HEAD_CHARS`` is keyed by its head and its
SHA-256 digest: the shuffle then moves at most 128 characters per distinct value
whatever the length of the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.operators.classes import ColumnInfo, batches

HEAD_CHARS = 64
MISSING_TOKEN = "None"
COLUMNS_PER_BATCH = 32


def _stacked(df: DataFrame, infos: list[ColumnInfo], keys: list) -> DataFrame:
    narrow = df.select([k.alias(f"v{i.ordinal}") for i, k in zip(infos, keys)])
    pairs = ", ".join(f"{i.ordinal}, v{i.ordinal}" for i in infos)
    return narrow.selectExpr(f"stack({len(infos)}, {pairs}) as (ordinal, value)")


def typed_histogram(df: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """``ordinal, value, cnt`` of non-missing values; all columns share one key family."""
    parts = [
        _stacked(df, batch, [i.key for i in batch])
        .where(F.col("value").isNotNull())
        .groupBy("ordinal", "value")
        .agg(F.count("*").alias("cnt"))
        for batch in batches(infos, COLUMNS_PER_BATCH)
    ]
    return reduce(DataFrame.unionAll, parts)


def text_histogram(df: DataFrame, infos: list[ColumnInfo]) -> DataFrame:
    """``ordinal, head, digest, cnt, nulls`` of text values.

    Missing values share the bucket of the text ``None``; ``nulls`` keeps how
    many of the bucket's rows were really missing.
    """
    parts = []
    for batch in batches(infos, COLUMNS_PER_BATCH):
        value = F.col("value")
        long = F.length(value) > HEAD_CHARS
        parts.append(
            _stacked(df, batch, [i.text for i in batch])
            .select(
                "ordinal",
                F.coalesce(F.left(value, F.lit(HEAD_CHARS)), F.lit(MISSING_TOKEN)).alias("head"),
                F.when(long, F.sha2(value, 256)).alias("digest"),
                value.isNull().cast("int").alias("is_null"),
            )
            .groupBy("ordinal", "head", "digest")
            .agg(F.count("*").alias("cnt"), F.sum("is_null").alias("nulls"))
        )
    return reduce(DataFrame.unionAll, parts)


def by_family(infos: list[ColumnInfo]) -> dict[str, list[ColumnInfo]]:
    families: dict[str, list[ColumnInfo]] = {}
    for info in infos:
        families.setdefault(info.key_family, []).append(info)
    return families
