from __future__ import annotations

import pytest

ODD = [
    None,
    "",
    " \t\n",
    "one",
    "the same text of a few words here",
    "the same text of a few words here",
    "x" * 200_000,
    "1" * 200_000,
    "word " * 30_000,
    "mail me@here.example.com or +1 (269) 555-3296 4524132264652876 now",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", len(t or ""), i, "x") for i, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (None, "no id but words", "en", "s0", 15, 1, "y"), (None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string"
    # size, fp, score, kept: names that operators use for columns of their own
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
