"""Column roles and quality warnings, as expressions over the per-column statistics.

Input is a statistics table with one row per column (``ordinal, name, dtype,
kind, missing_pct, unique_count, date_min``) and the row count of the dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name patterns of the roles.
ID_NAME = r"(?i)(^id$|_id$|^uuid$|key$)"
TARGET_NAME = r"(?i)(target|label|revenue|sales|price|amount|count|score)"
DATE_NAME = r"(?i)(date|day|month|year|time|timestamp)"
REVENUE_NAME = r"(?i)(revenue|sales|amount|price|gmv|arr|mrr|income|profit|cost)"

# Only these types can be identifiers by uniqueness.
ID_TYPES = ["bigint", "string"]

ROLES = ["id", "target", "date", "metric", "revenue", "dimension"]


def role_flags(rows: Column) -> dict[str, Column]:
    """One boolean expression per role; ``rows`` is the row count of the dataset."""
    name, distinct = F.col("name"), F.col("unique_count")
    numeric = F.col("kind").isin("numeric", "boolean")
    half = rows * F.lit(0.5)
    is_id = name.rlike(ID_NAME) | (F.col("dtype").isin(ID_TYPES) & (distinct == rows) & (distinct > 0))
    few = (distinct > 1) & (distinct < F.greatest(half, F.lit(2.0)))
    return {
        "id": is_id,
        "target": name.rlike(TARGET_NAME) | (numeric & few),
        "date": F.col("date_min").isNotNull() | name.rlike(DATE_NAME),
        "metric": numeric & ~is_id,
        "revenue": numeric & name.rlike(REVENUE_NAME),
        "dimension": ~numeric
        & F.col("date_min").isNull()
        & ~is_id
        & (distinct > 1)
        & (distinct <= F.greatest(half, F.lit(10.0))),
    }


def with_roles(stats: DataFrame, rows: int | Column) -> DataFrame:
    """Add the boolean columns ``is_id, is_target, ...``; ``unique_count`` may be null where no role depends on it."""
    rows = rows if isinstance(rows, Column) else F.lit(rows)
    return stats.withColumns({f"is_{role}": F.coalesce(flag, F.lit(False)) for role, flag in role_flags(rows).items()})


def role_arrays() -> list[Column]:
    """Aggregates: one array of column names per role, in column order."""
    return [
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col(f"is_{r}"), F.struct("ordinal", "name")))),
            lambda x: x["name"],
        ).alias(f"{r}_columns")
        for r in ROLES
    ]


def role_lists(stats_with_roles: DataFrame) -> DataFrame:
    """One row with an array of column names per role."""
    return stats_with_roles.agg(*role_arrays())


def column_warnings() -> Column:
    """The warnings of one column, as an array."""
    label = F.concat(F.lit("Column '"), F.col("name"), F.lit("'"))
    missing = F.when(
        F.col("missing_pct") > 50,
        F.concat(label, F.format_string(" has %.1f%% missing values", "missing_pct")),
    )
    constant = F.when(F.col("unique_count") == 1, F.concat(label, F.lit(" has only one unique value")))
    return F.array_compact(F.array(missing, constant))


def duplicate_warning(count: Column) -> Column:
    return F.when(count > 0, F.format_string("Found %d duplicate rows", count))


def quality_warnings(stats: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Rows ``position, warning``: column warnings in column order, then duplicates."""
    per_column = stats.select("ordinal", F.posexplode(column_warnings()).alias("k", "warning")).select(
        (F.col("ordinal") * 2 + F.col("k")).cast("bigint").alias("position"), "warning"
    )
    table = duplicates.select(
        F.lit(2**40).alias("position"), duplicate_warning(F.col("duplicate_count")).alias("warning")
    ).where(F.col("warning").isNotNull())
    return per_column.unionAll(table)
