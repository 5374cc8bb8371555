"""Questions to the log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQL_TOOL = "run_sql"
PREVIEW_ROWS = 5


def events_by_type(events: DataFrame) -> DataFrame:
    """``event_type, n_events, first_seen, last_seen``."""
    return events.groupBy("event_type").agg(
        F.count("*").alias("n_events"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def artifacts_of_type(artifacts: DataFrame, artifact_type: str | None = None) -> DataFrame:
    return artifacts.where(F.col("artifact_type") == artifact_type) if artifact_type else artifacts


def _field(name: str) -> Column:
    return F.get_json_object("result", f"$.{name}")


def successful_sql(results: DataFrame, tool_name: str = SQL_TOOL) -> DataFrame:
    return results.where((F.col("tool_name") == tool_name) & F.col("success"))


def last_sql_result(results: DataFrame, tool_name: str = SQL_TOOL, rows: int = PREVIEW_ROWS) -> DataFrame:
    """Per session the latest successful SQL result: its query, artifact and first rows (JSON).

    ``max_by`` keeps one record per session and task, so a session that holds a
    large share of all results does not gather anywhere.
    """
    latest = successful_sql(results, tool_name).groupBy("session_id").agg(
        F.max("seq").alias("seq"), F.max_by("result", "seq").alias("result")
    )
    preview = F.from_json(_field("preview_rows"), "array<string>")
    return latest.select(
        "session_id",
        "seq",
        _field("query").alias("query"),
        _field("artifact_path").alias("artifact_path"),
        F.slice(F.coalesce(preview, F.array().cast("array<string>")), 1, rows).alias("preview_rows"),
    )


def repeated_failures(results: DataFrame, at_least: int = 2) -> DataFrame:
    """``session_id, tool_name, query, error, n_failures`` of equal failed calls."""
    return (
        results.where(~F.col("success"))
        .withColumn("query", _field("query"))
        .groupBy("session_id", "tool_name", "query", "error")
        .agg(F.count("*").alias("n_failures"))
        .where(F.col("n_failures") >= at_least)
    )


def tool_summary(results: DataFrame) -> DataFrame:
    """Per call: ``status``, the artifact it left and its error."""
    given = F.when(_field("artifact_path") != "", _field("artifact_path"))
    return results.select(
        "session_id",
        "seq",
        "tool_name",
        F.when(F.col("success"), F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        F.coalesce(given, _field("path")).alias("artifact"),
        _field("error").alias("error"),
    )
