"""Redaction, truncation, slugs and message parsing over whole text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.text import PII_PATTERNS, PII_TOKENS, parse_message, redact_text, slug, truncate_text
from tabscope.operators.privacy import redact_rows, sample_rows, with_pii_counts
from tabscope.plans.coverage.registry import register, table


def redacted_sql(expr: str, kinds: list[str] | None = None) -> str:
    for kind in list(PII_PATTERNS) if kinds is None else kinds:
        expr = f"regexp_replace({expr}, '{PII_PATTERNS[kind]}', '{PII_TOKENS[kind]}', 'g')"
    return expr


@register("redact_documents", f"SELECT doc_id, {redacted_sql('text')} AS text FROM documents")
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redact_text(F.col("text")).alias("text"))


@register("redact_pages", f"SELECT page_id, {redacted_sql('html')} AS html FROM pages")
def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", redact_text(F.col("html")).alias("html"))


ROW_COLUMNS = {"event_id": "VARCHAR", "user_id": "VARCHAR", "event_type": "VARCHAR", "props": "VARCHAR"}


@register(
    "redact_rows",
    "SELECT "
    + ", ".join(f"{redacted_sql(f'CAST({c} AS VARCHAR)')} AS {c}" for c in ROW_COLUMNS)
    + f", {redacted_sql('CAST(5550000000 + event_id AS VARCHAR)')} AS phone FROM events",
)
def redact_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value as redacted text; the derived ten-digit integers read as phones."""
    events = table(spark, sf_dir, "events")
    return redact_rows(events.select(*ROW_COLUMNS, (F.lit(5550000000) + F.col("event_id")).alias("phone")))


def _count_sql(kind: str) -> str:
    earlier = list(PII_PATTERNS)[: list(PII_PATTERNS).index(kind)]
    return f"len(regexp_extract_all({redacted_sql('text', earlier)}, '{PII_PATTERNS[kind]}')) AS {kind}"


@register("pii_counts", "SELECT doc_id, " + ", ".join(_count_sql(k) for k in PII_PATTERNS) + " FROM documents")
def pii_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = with_pii_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return counted.select("doc_id", *[F.col(k).cast("bigint").alias(k) for k in PII_PATTERNS])


@register(
    "sample_redacted",
    "SELECT "
    + ", ".join(f"{redacted_sql(f'CAST({c} AS VARCHAR)')} AS {c}" for c in ("page_id", "url", "html"))
    + " FROM pages ORDER BY pages.page_id LIMIT 5",
)
def sample_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows; the tables are written in key order."""
    return sample_rows(table(spark, sf_dir, "pages"), 5)


@register(
    "truncate_text",
    r"""SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 1000) || chr(10) || '... [truncated]' ELSE text END AS text,
               length(text) > 1000 AS truncated FROM documents""",
)
def truncate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, truncated = truncate_text(F.col("text"), 1000)
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), truncated.alias("truncated"))


@register(
    "slug",
    """SELECT conv_id, turn, left(CASE WHEN s = '' THEN 'analysis' ELSE s END, 60) AS slug
       FROM (SELECT conv_id, turn,
                    regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s
             FROM conversations)""",
)
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", slug(F.col("text")).alias("slug"))


@register(
    "parse_messages",
    """SELECT conv_id, turn,
              CASE turn % 4 WHEN 3 THEN NULL WHEN 2 THEN 'tool_call' ELSE 'final' END AS kind,
              CASE WHEN turn % 4 IN (0, 1) THEN text END AS content,
              CASE WHEN turn % 4 = 2 THEN role END AS tool_name,
              CASE WHEN turn % 4 = 2 THEN text END AS query
       FROM conversations""",
)
def parse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns written as bare JSON, fenced JSON, JSON inside prose and prose."""
    final = F.to_json(F.struct(F.lit("final").alias("type"), F.col("text").alias("content")))
    call = F.to_json(
        F.struct(
            F.lit("tool_call").alias("type"),
            F.col("role").alias("tool_name"),
            F.struct(F.col("text").alias("query")).alias("arguments"),
        )
    )
    form = F.col("turn") % 4
    raw = (
        F.when(form == 0, final)
        .when(form == 1, F.concat(F.lit("Here:\n```json\n"), final, F.lit("\n```\n")))
        .when(form == 2, F.concat(F.lit("I will call "), call, F.lit(" now")))
        .otherwise(F.concat(F.lit("{"), F.col("text")))
    )
    parsed = table(spark, sf_dir, "conversations").select("conv_id", "turn", parse_message(raw).alias("m"))
    return parsed.select(
        "conv_id", "turn", "m.kind", "m.content", "m.tool_name", F.get_json_object("m.arguments", "$.query").alias("query")
    )
