"""Log tables: records are written as JSON text from the test tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.logs import (
    artifacts_of_type,
    events_by_type,
    last_sql_result,
    repeated_failures,
    tool_summary,
)
from tabscope.plans.coverage.registry import register, table
from tabscope.session import scratch_path
from tabscope.sources.logs import ARTIFACT_SCHEMA, ASSUMPTION_SCHEMA, EVENT_SCHEMA, parse_lines, read_assumptions, read_events
from tabscope.streaming.appended import follow_appended_events


def _record(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("line")


EVENTS_SQL = """SELECT event_type, COUNT(*) AS n_events, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen,
              strftime(MAX(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM events GROUP BY event_type"""


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        _record(
            id=F.concat(F.lit("evt-"), "event_id"),
            event_type=F.col("event_type"),
            timestamp=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
            inputs=F.struct(F.col("user_id").alias("path")),
            outputs=F.struct("value"),
        )
    )


def _written(lines: DataFrame) -> str:
    """The lines as text files of a log folder."""
    path = scratch_path(lines.sparkSession, "log")
    lines.write.text(path)
    return path


def _by_type(events: DataFrame) -> DataFrame:
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return events_by_type(events).select(
        "event_type", "n_events", *[F.date_format(c, stamp).alias(c) for c in ("first_seen", "last_seen")]
    )


@register("log_events", EVENTS_SQL)
def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_type(parse_lines(_event_lines(spark, sf_dir), "line", EVENT_SCHEMA))


@register("log_events_files", EVENTS_SQL)
def log_events_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the files of a log."""
    return _by_type(read_events(spark, _written(_event_lines(spark, sf_dir))))


@register("log_events_stream", EVENTS_SQL)
def log_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over the log, stopped and started again after a part of it."""
    lines = _event_lines(spark, sf_dir)
    early = F.xxhash64("line") % 3 == 0
    log = _written(lines.where(early))
    arrived, checkpoint = scratch_path(spark, "arrived"), scratch_path(spark, "stream")
    for more in (None, lines.where(~early)):
        if more is not None:
            more.write.mode("append").text(log)
        events = follow_appended_events(spark, log, ".txt", split_bytes=1 << 20)
        query = (
            events.writeStream.format("parquet").option("path", arrived)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return _by_type(spark.read.parquet(arrived))


@register(
    "log_artifacts",
    """SELECT 'art-' || page_id AS id, url AS path, 'chart' AS artifact_type, length(html) AS size
       FROM pages WHERE url LIKE '%page=%'""",
)
def log_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of one type."""
    lines = table(spark, sf_dir, "pages").select(
        _record(
            id=F.concat(F.lit("art-"), "page_id"),
            path=F.col("url"),
            artifact_type=F.when(F.contains("url", F.lit("page=")), "chart").otherwise("report"),
            metadata=F.struct(F.length("html").alias("size")),
        )
    )
    found = artifacts_of_type(parse_lines(lines, "line", ARTIFACT_SCHEMA), "chart")
    size = F.get_json_object("metadata", "$.size").cast("bigint")
    return found.select("id", "path", "artifact_type", size.alias("size"))


ASSUMPTIONS_SQL = """SELECT 'asm-' || conv_id || '-' || turn AS id, text, role AS source,
              CASE WHEN turn = 0 THEN 'high' END AS confidence FROM conversations"""


def _assumption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        _record(
            id=F.concat(F.lit("asm-"), "conv_id", F.lit("-"), "turn"),
            text=F.col("text"),
            source=F.col("role"),
            confidence=F.when(F.col("turn") == 0, F.lit("high")),
        )
    )


@register("log_assumptions", ASSUMPTIONS_SQL)
def log_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(_assumption_lines(spark, sf_dir), "line", ASSUMPTION_SCHEMA).drop("timestamp")


@register("log_assumptions_files", ASSUMPTIONS_SQL)
def log_assumptions_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the files of a log."""
    return read_assumptions(spark, _written(_assumption_lines(spark, sf_dir))).drop("timestamp")


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a tool result of the user's session."""
    query = F.concat(F.lit("SELECT "), F.get_json_object("props", "$.k"))
    success = F.col("event_type") != "error"
    is_sql = F.col("event_type").isin("purchase", "click", "error")
    rows = F.transform(
        F.sequence(F.lit(1), (F.col("event_id") % 7 + 1).cast("int")), lambda i: F.struct(i.alias("n"))
    )
    result = F.to_json(
        F.struct(
            query.alias("query"),
            F.when(success, rows).alias("preview_rows"),
            F.when(F.col("event_type") == "purchase", F.concat(F.lit("queries/"), "event_id", F.lit(".sql"))).alias("artifact_path"),
            F.when(F.col("event_type") == "view", F.concat(F.lit("files/"), "event_id")).alias("path"),
            F.when(~success, F.lit("no such column")).alias("error"),
        )
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.when(is_sql, F.lit("run_sql")).otherwise(F.lit("inspect_dataset")).alias("tool_name"),
        success.alias("success"),
        result.alias("result"),
        F.when(~success, F.lit("no such column")).alias("error"),
    )


@register(
    "log_last_sql",
    """SELECT user_id AS session_id, event_id AS seq, 'SELECT ' || json_extract_string(props, '$.k') AS query,
              CASE WHEN event_type = 'purchase' THEN 'queries/' || event_id || '.sql' END AS artifact_path,
              least(event_id % 7 + 1, 5) AS n_rows, '{"n":1}' AS first_row
       FROM events WHERE event_type IN ('purchase', 'click')
       QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
)
def log_last_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = last_sql_result(tool_results(spark, sf_dir))
    return latest.select(
        "session_id",
        "seq",
        "query",
        "artifact_path",
        F.size("preview_rows").cast("bigint").alias("n_rows"),
        F.element_at("preview_rows", 1).alias("first_row"),
    )


@register(
    "log_repeat_failures",
    """SELECT user_id AS session_id, 'run_sql' AS tool_name, 'SELECT ' || json_extract_string(props, '$.k') AS query,
              'no such column' AS error, COUNT(*) AS n_failures
       FROM events WHERE event_type = 'error' GROUP BY ALL HAVING COUNT(*) >= 2""",
)
def log_repeat_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_failures(tool_results(spark, sf_dir))


@register(
    "log_tool_summary",
    """SELECT user_id AS session_id, event_id AS seq,
              CASE WHEN event_type IN ('purchase', 'click', 'error') THEN 'run_sql' ELSE 'inspect_dataset' END AS tool_name,
              CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
              CASE event_type WHEN 'purchase' THEN 'queries/' || event_id || '.sql' WHEN 'view' THEN 'files/' || event_id END AS artifact,
              CASE WHEN event_type = 'error' THEN 'no such column' END AS error FROM events""",
)
def log_tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_summary(tool_results(spark, sf_dir))
