"""Provenance logs as tables: events, artifacts, assumptions and session traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Free-form parts of a record (inputs, results, metadata) stay raw JSON text.
EVENT_SCHEMA = (
    "id string, event_type string, timestamp timestamp, inputs string, outputs string,"
    " reason string, tool_source string, artifact_paths array<string>"
)
ARTIFACT_SCHEMA = (
    "id string, path string, artifact_type string, description string, metadata string, created_at timestamp"
)
ASSUMPTION_SCHEMA = "id string, text string, source string, confidence string, timestamp timestamp"
TOOL_RESULT = "struct<tool_name: string, success: boolean, result: string, error: string, repair_hint: string>"
SESSION_SCHEMA = (
    "messages array<struct<role: string, content: string, tool_call_id: string, name: string>>,"
    f" tool_results array<{TOOL_RESULT}>, final_content string, report_path string,"
    " chart_path string, artifacts array<string>, assumptions array<string>"
)


def parse_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Records of a JSON-lines text column; blank lines are left out."""
    return lines.where(F.trim(column) != "").select(F.from_json(column, schema).alias("r")).select("r.*")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).json(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTIFACT_SCHEMA).option("multiLine", True).json(path)


def read_assumptions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASSUMPTION_SCHEMA).json(path)


def _session_id() -> Column:
    return F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row per session file, keyed by the file name."""
    raw = spark.read.schema(SESSION_SCHEMA).option("multiLine", True).json(path)
    return raw.select(_session_id().alias("session_id"), "*")


def tool_results(sessions: DataFrame) -> DataFrame:
    """One row per tool result: ``session_id, seq, tool_name, success, result, error, repair_hint``."""
    return sessions.select("session_id", F.posexplode("tool_results").alias("seq", "r")).select(
        "session_id", "seq", "r.*"
    )


def messages(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", F.posexplode("messages").alias("seq", "m")).select("session_id", "seq", "m.*")
