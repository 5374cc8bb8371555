from __future__ import annotations

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscope.functions.text import PII_PATTERNS, PII_TOKENS, parse_message, pii_counts, redact_text, slug, truncate_text
from tabscope.operators.privacy import redact_rows


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def applied(spark, values, column):
    return [r[0] for r in texts(spark, values).select(column).collect()]


def python_redact(text: str) -> str:
    for kind, pattern in PII_PATTERNS.items():
        text = re.sub(pattern, PII_TOKENS[kind], text)
    return text


CASES = [
    "Contact user@example.com for details",
    "call 555-123-4567 or (555) 123 4567 or +1 555.123.4567 now",
    "ssn 123-45-6789.",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1",
    "4111111111111111",
    "é1234567890 1234567890é _1234567890",
    "no data",
    "",
    "a@b.co 555-123-4567 123-45-6789 4111 1111 1111 1111",
    "٠١٢-٣٤-٥٦٧٨",
]


def test_redaction_matches_python(spark):
    assert applied(spark, CASES, redact_text(F.col("t"))) == [python_redact(c) for c in CASES]
    assert applied(spark, [None], redact_text(F.col("t"))) == [None]


alphabet = st.text(alphabet="0123456789-. ()+@ab.coé_\n", max_size=60)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(alphabet, min_size=20, max_size=60))
def test_redaction_property(spark, values):
    assert applied(spark, values, redact_text(F.col("t"))) == [python_redact(v) for v in values]


def test_counts(spark):
    row = texts(spark, [CASES[8]]).select([c.alias(k) for k, c in pii_counts(F.col("t")).items()]).first()
    assert row.asDict() == {"email": 1, "phone": 1, "ssn": 1, "cc": 1}
    none = texts(spark, [None]).select([c.alias(k) for k, c in pii_counts(F.col("t")).items()]).first()
    assert none.asDict() == {"email": None, "phone": None, "ssn": None, "cc": None}


def test_redact_rows(spark):
    df = spark.createDataFrame([(5551234567, None, [1], True)], "a bigint, b string, c array<int>, d boolean")
    assert tuple(redact_rows(df).first()) == ("[REDACTED_PHONE]", None, "[1]", "true")


def test_truncate(spark):
    text, cut = truncate_text(F.col("t"), 3)
    rows = texts(spark, ["abc", "abcd", "éééé"]).select(text.alias("x"), cut.alias("c")).collect()
    assert [tuple(r) for r in rows] == [("abc", False), ("abc\n... [truncated]", True), ("ééé\n... [truncated]", True)]


def test_slug(spark):
    values = ["Why did Revenue drop?", "---", "", "é", "x" * 80]
    assert applied(spark, values, slug(F.col("t"))) == ["why-did-revenue-drop", "analysis", "analysis", "analysis", "x" * 60]


def test_parse_message(spark):
    values = [
        '{"type": "final", "content": "a {b} c"}',
        'text ```json\n{"type": "tool_call", "tool_name": "q", "arguments": {"a": {"b": 1}}}\n``` more',
        'prefix {"type": "final", "content": "x"} suffix',
        '{"type": "tool_call", "tool_name": "q"}',
        '{"type": "final"}',
        '{"type": "other"}',
        "{not json",
        "no json",
        "",
        None,
    ]
    rows = [r[0] for r in texts(spark, values).select(parse_message(F.col("t"))).collect()]
    assert [tuple(r) for r in rows] == [
        ("final", "a {b} c", None, None),
        ("tool_call", None, "q", '{"a":{"b":1}}'),
        ("final", "x", None, None),
        ("tool_call", None, "q", "{}"),
        ("final", "", None, None),
        (None, None, None, None),
        (None, None, None, None),
        (None, None, None, None),
        (None, None, None, None),
        (None, None, None, None),
    ]
