"""Full-row duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.names import col


def _groupable(df: DataFrame) -> DataFrame:
    """Maps and variants cannot be grouped; their JSON text can."""
    return df.select(
        [
            F.to_json(col(f.name)).alias(f.name) if _ungroupable(f.dataType) else col(f.name)
            for f in df.schema.fields
        ]
    )


def _ungroupable(data_type: T.DataType) -> bool:
    if isinstance(data_type, (T.MapType, T.VariantType)):
        return True
    if isinstance(data_type, T.ArrayType):
        return _ungroupable(data_type.elementType)
    return isinstance(data_type, T.StructType) and any(_ungroupable(f.dataType) for f in data_type.fields)


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row ``duplicate_count``: rows that repeat another row on all columns.

    Equal rows have equal hashes, so a first pass shuffles 8 bytes per row and
    usually shows that nothing repeats. Only rows whose hash repeats are then
    compared in full; Spark broadcasts the repeated hashes by their measured size.
    Copies of one row collapse in each task before they are shuffled.
    """
    rows = _groupable(df)
    repeated = (
        rows.select(F.xxhash64(*[col(c) for c in rows.columns]).alias("_hash"))
        .groupBy("_hash")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
    )
    if repeated.isEmpty():
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("duplicate_count"))
    rows = (
        rows.withColumn("_hash", F.xxhash64(*[col(c) for c in rows.columns]))
        .join(repeated.select("_hash"), "_hash", "left_semi")
        .drop("_hash")
    )
    return (
        rows.groupBy([col(c) for c in rows.columns])
        .agg(F.count("*").alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))
    )
