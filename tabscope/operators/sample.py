"""Samples of an exact size that do not depend on how rows lie in files or partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.functions.names import col

#: Between the seed and the values in the text that is hashed; a null value is one more.
SEPARATOR = "\x1f"


def sample_hash(columns: list[str], seed: int) -> Column:
    """The MD5 digest, as hexadecimal text, of seed and values."""
    values = [F.coalesce(col(c).cast("string"), F.lit(SEPARATOR)) for c in columns]
    return F.md5(F.concat_ws(SEPARATOR, F.lit(str(seed)), *values).cast("binary"))


def exact_sample(df: DataFrame, n: int, seed: int = 0, keys: list[str] | None = None) -> DataFrame:
    """``n`` rows (all, if there are fewer): those with the least hashes of ``keys`` and ``seed``.

    ``keys`` are all columns by default, nested ones as JSON need a key of their own. Rows
    equal in the keys go by their other columns, so only rows equal in all of them can
    stand for one another, and every run and partitioning gives the same sample.

    A row count and a bound on the hash leave little more than ``n`` rows, of which each
    task sends its ``n`` least at most; if chance leaves too few, all rows are sorted so.
    """
    if n < 0:
        raise ValueError("a sample has 0 rows or more")
    names = keys or df.columns
    hashed = df.withColumn("_sample_hash", sample_hash(names, seed))
    total = df.count()
    share = (n + 8 * math.sqrt(n) + 32) / total if total else 1.0
    if share < 1:
        near = hashed.where(F.col("_sample_hash") < f"{int(share * 2**52):013x}")
        hashed = near if near.count() >= n else hashed
    others = [col(c) for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")]
    return hashed.orderBy("_sample_hash", *others).limit(n).drop("_sample_hash")
