"""Saved profiles: one table, partitioned by dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.session import small_frame
from tabscope.sources.files import path_exists, resolve_path


def dataset_key(path: str):
    """Partition key of a dataset; unlike a base name it never collides."""
    return F.sha2(F.lit(resolve_path(path)), 256)


def save_profile(profile: DataFrame, root: str) -> None:
    """Write a profile; an earlier profile of the same dataset is replaced, others stay."""
    (
        profile.withColumn("dataset_key", F.sha2("path", 256))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_key")
        .parquet(root)
    )


def load_profile(spark: SparkSession, path: str, root: str) -> DataFrame | None:
    """The saved profile of a dataset (no rows if it has none, None without a store); reads one partition."""
    if not path_exists(spark, root):
        return None
    return spark.read.parquet(root).where(F.col("dataset_key") == dataset_key(path)).drop("dataset_key")


def list_profiled(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every profiled dataset."""
    if not path_exists(spark, root):
        return small_frame(spark, [], "path string")
    return spark.read.parquet(root).select("path").distinct()
