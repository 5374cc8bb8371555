"""SQL over dataset files: views by file stem, bounded preview, full row count."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError

from tabscope.functions.names import quoted
from tabscope.session import child_session
from tabscope.sources.delimited import read_sql_csv
from tabscope.sources.files import path_exists, resolve_path

PREVIEW_ROWS = 50


@dataclass
class SqlResult:
    query: str
    row_count: int = 0
    column_names: list[str] = field(default_factory=list)
    preview_rows: list[dict[str, Any]] = field(default_factory=list)
    truncated: bool = False
    execution_time_seconds: float = 0.0
    error: str | None = None


def view_name(path: str) -> str:
    """File stem with ``-`` and blanks as ``_``."""
    stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    return stem.replace("-", "_").replace(" ", "_")


def as_paths(paths: str | list[str] | None, default: str | list[str] | None = None) -> list[str]:
    """A list of paths from a path, a list or nothing (then the default)."""
    chosen = paths if paths is not None else default
    if chosen is None:
        return []
    return [chosen] if isinstance(chosen, str) else list(chosen)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Data file not found: {path}")
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        return read_sql_csv(spark, path)
    if ext == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported data file for SQL: {ext}")


def open_workspace(spark: SparkSession, paths: str | list[str]) -> SparkSession:
    """A child session with one view per dataset; views do not leak between calls."""
    child = child_session(spark)
    seen: dict[str, str] = {}
    for path in as_paths(paths):
        full = resolve_path(path)
        name = view_name(full)
        if seen.setdefault(name.lower(), full) != full:
            raise ValueError(f"Two datasets share the view name {name}: {seen[name.lower()]} and {full}")
        _scan(child, full).createOrReplaceTempView(quoted(name))
    return child


def run_sql(
    spark: SparkSession,
    query: str,
    paths: str | list[str] | None = None,
    max_rows: int = PREVIEW_ROWS,
    default_paths: str | list[str] | None = None,
) -> SqlResult:
    """Run a query over dataset files. Errors are returned in the result, not raised.

    At most ``max_rows + 1`` rows reach the driver; the total is a separate count,
    for which Spark prunes the columns. The elapsed time leaves the count out.
    """
    start = time.perf_counter()
    result = SqlResult(query)
    try:
        df = open_workspace(spark, as_paths(paths, default_paths)).sql(query)
        result.column_names = df.columns
        rows = df.limit(max_rows + 1).collect()
        result.truncated = len(rows) > max_rows
        result.preview_rows = [r.asDict() for r in rows[:max_rows]]
        result.execution_time_seconds = round(time.perf_counter() - start, 4)
        result.row_count = df.count() if result.truncated else len(rows)
    except (PySparkException, Py4JJavaError, OSError, ValueError) as e:
        return SqlResult(query, execution_time_seconds=round(time.perf_counter() - start, 4), error=str(e))
    return result
