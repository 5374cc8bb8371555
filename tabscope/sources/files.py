"""Format detection and dataset scans."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.session import small_frame
from tabscope.sources.delimited import read_profile_csv

# File extension -> dataset format.
FORMATS = {".csv": "csv", ".parquet": "parquet", ".xlsx": "excel", ".xls": "excel"}


def detect_file_type(path: str) -> str:
    """Dataset format from the lower-cased extension of a file or part-file folder."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"Unsupported file type: {ext}")
    return FORMATS[ext]


def resolve_path(path: str) -> str:
    """Absolute form of a local path; a path with a scheme is already absolute."""
    return path if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://?", path) else os.path.abspath(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system behind ``path`` (local, HDFS or object store) has it."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path))


def load_dataset(spark: SparkSession, path: str, file_type: str | None = None, bad_rows: str = "raise") -> DataFrame:
    """Scan a CSV or Parquet dataset. Workbooks have no Spark source.

    ``bad_rows`` says what CSV rows with surplus fields do: ``raise``, or ``cut``.
    """
    kind = file_type or detect_file_type(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return read_profile_csv(spark, path, bad_rows=bad_rows)
    raise ValueError(f"Cannot load file type: {kind}")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` as ``path, rel_path, length, modification_time``.

    The content column is not selected, so no file body is read. A root that does not
    exist has no files.
    """
    if not path_exists(spark, root):
        empty = "path string, rel_path string, length bigint, modification_time timestamp"
        return small_frame(spark, [], empty).select("path", "length", "modification_time", "rel_path")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("modification_time"))
    )
    base = F.lit(re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", resolve_path(root)).rstrip("/") + "/")
    bare = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    # The listing may name a host before the folder that ``root`` leaves out.
    at = F.instr(bare, base)
    return files.withColumn("rel_path", F.when(at > 0, F.substr(bare, at + F.length(base))).otherwise(bare))


def dataset_size(spark: SparkSession, path: str) -> DataFrame:
    """``file_count`` and ``file_size_bytes`` of a dataset, from the file listing."""
    return list_files(spark, path).agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("file_size_bytes"),
    )
