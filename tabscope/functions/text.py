"""Text expressions: redaction, truncation, slugs and message parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The personal-data patterns and their replacements, in the order
# in which they apply (a phone inside a longer number wins first).
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "cc": r"\b(?:\d[ -]*?){13,16}\b",
}
PII_TOKENS = {
    "email": "[REDACTED_EMAIL]",
    "phone": "[REDACTED_PHONE]",
    "ssn": "[REDACTED_SSN]",
    "cc": "[REDACTED_CC]",
}

# Unicode classes, so that a word boundary next to an accented letter does not
# depend on the Java version.
UNICODE = "(?U)"

TRUNCATION_MARK = "\n... [truncated]"
SLUG_CHARS = 60
SLUG_DEFAULT = "analysis"


def _has_digit(text: Column) -> Column:
    return text.rlike(UNICODE + r"\d")


def _replaced(kind: str, text: Column) -> Column:
    return F.regexp_replace(text, UNICODE + PII_PATTERNS[kind], PII_TOKENS[kind])


def _email_free(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), _replaced("email", text)).otherwise(text)


def redact_text(text: Column) -> Column:
    """All four replacements in order.

    An e-mail needs an ``@`` and the other kinds need digits, and no replacement
    brings new ones, so clean text pays for two cheap tests only.
    """
    no_email = _email_free(text)
    numbers = no_email
    for kind in ("phone", "ssn", "cc"):
        numbers = _replaced(kind, numbers)
    return F.when(_has_digit(text), numbers).otherwise(no_email)


def pii_counts(text: Column) -> dict[str, Column]:
    """Replacements that redaction makes per kind, each counted after the earlier ones."""

    def found(kind: str, rest: Column, possible: Column) -> Column:
        count = F.regexp_count(rest, F.lit(UNICODE + PII_PATTERNS[kind]))
        return F.when(possible, count).otherwise(F.when(text.isNotNull(), F.lit(0)))

    counts = {"email": found("email", text, F.contains(text, F.lit("@")))}
    rest = _email_free(text)
    for kind in ("phone", "ssn", "cc"):
        counts[kind] = found(kind, rest, _has_digit(text))
        rest = _replaced(kind, rest)
    return counts


def truncate_text(text: Column, max_chars: int) -> tuple[Column, Column]:
    """The text cut to ``max_chars`` plus a mark, and whether it was cut."""
    cut = F.length(text) > max_chars
    return F.when(cut, F.concat(F.left(text, F.lit(max_chars)), F.lit(TRUNCATION_MARK))).otherwise(text), cut


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    stripped = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.left(F.when(stripped == "", F.lit(SLUG_DEFAULT)).otherwise(stripped), F.lit(SLUG_CHARS))


# Fixed value: a JSON object in a fenced block.
FENCED_OBJECT = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def message_json(text: Column) -> Column:
    """The JSON of a message: a fenced block, else the whole text, else first { to last }."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    fenced = F.regexp_extract(trimmed, FENCED_OBJECT, 1)
    body = F.when(fenced != "", fenced).otherwise(trimmed)
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body).when(F.try_parse_json(inner).isNotNull(), inner)


def parse_message(text: Column) -> Column:
    """``struct<kind, content, tool_name, arguments>``; kind is null for other text."""
    body = message_json(text)
    kind = F.get_json_object(body, "$.type")
    final, call = kind == "final", kind == "tool_call"
    return F.struct(
        F.when(final | call, kind).alias("kind"),
        F.when(final, F.coalesce(F.get_json_object(body, "$.content"), F.lit(""))).alias("content"),
        F.when(call, F.get_json_object(body, "$.tool_name")).alias("tool_name"),
        F.when(call, F.coalesce(F.get_json_object(body, "$.arguments"), F.lit("{}"))).alias("arguments"),
    )
