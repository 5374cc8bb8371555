"""Monthly trend of a metric, its changes, and where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.dates import month_key, parse_date
from tabscope.functions.names import col


def choose_trend_columns(roles: dict[str, list[str]]) -> tuple[str, str] | None:
    """First date column with the first revenue column, else the first metric column."""
    metrics = roles["revenue_columns"] or roles["metric_columns"]
    if not roles["date_columns"] or not metrics:
        return None
    return roles["date_columns"][0], metrics[0]


def _date(df: DataFrame, name: str) -> Column:
    is_text = isinstance(df.schema[name].dataType, T.StringType)
    return parse_date(col(name)) if is_text else col(name).cast("timestamp_ntz")


def _missing_free(df: DataFrame, date_column: str, value: Column) -> DataFrame:
    return df.select("*", _date(df, date_column).alias("_date"), value.alias("_value")).dropna(
        subset=["_date", "_value"]
    )


def monthly_sum(df: DataFrame, date_column: str, metric: str | Column, name: str = "total") -> DataFrame:
    """``month, <name>`` in month order; rows without date or metric are left out.

    Rows collapse to months before the shuffle, so at most one record per month
    and task moves, whatever the distribution of dates.
    """
    value = metric if isinstance(metric, Column) else col(metric)
    # Grouping by the truncated date is cheaper than by its text, written once per month.
    return (
        _missing_free(df, date_column, value)
        .groupBy(F.trunc("_date", "MM").alias("_month"))
        .agg(F.sum("_value").alias(name))
        .select(month_key(F.col("_month")).alias("month"), name)
        .orderBy("month")
    )


def month_over_month(monthly: DataFrame, name: str = "total") -> DataFrame:
    """Add ``previous, change, change_pct`` against the month before it in the table.

    The one window partition holds one row per month, so it is bounded by the calendar.
    """
    previous = F.lag(name).over(W.partitionBy(F.lit(0)).orderBy("month"))
    change = F.col(name) - F.col("previous")
    return (
        monthly.withColumn("previous", previous)
        .withColumn("change", change)
        .withColumn("change_pct", F.when(F.col("previous") != 0, F.col("change") * 100 / F.col("previous")))
    )


def metric_by_dimension(df: DataFrame, dimension: str, metric: str | Column, name: str = "total") -> DataFrame:
    """``<dimension>, <name>, share`` of the grand total, largest first."""
    value = metric if isinstance(metric, Column) else col(metric)
    totals = df.groupBy(col(dimension).alias(dimension)).agg(F.sum(value).alias(name))
    # The scalar subquery sums the grouped rows and reuses their exchange.
    grand = totals.agg(F.sum(name)).scalar()
    return totals.select(
        col(dimension),
        F.col(name),
        F.when(grand != 0, F.col(name).cast("double") / grand.cast("double")).alias("share"),
    ).orderBy(F.desc(name), col(dimension))


def _within(date: Column, month: str) -> Column:
    year, number = map(int, month.split("-"))
    following = f"{year + number // 12:04d}-{number % 12 + 1:02d}"
    start, end = (F.lit(f"{m}-01").cast("timestamp_ntz") for m in (month, following))
    return (date >= start) & (date < end)


def change_by_dimension(
    df: DataFrame, date_column: str, metric: str | Column, dimension: str, month: str, previous_month: str
) -> DataFrame:
    """``<dimension>, previous, current, change`` between two months, largest drop first."""
    value = metric if isinstance(metric, Column) else col(metric)
    rows = _missing_free(df, date_column, value)
    zero = F.sum("_value") * 0

    def of(m: str) -> Column:
        return F.coalesce(F.sum(F.when(_within(F.col("_date"), m), F.col("_value"))), zero)

    # Plain date bounds, not month keys, so that the scan can skip row groups.
    return (
        rows.where(_within(F.col("_date"), month) | _within(F.col("_date"), previous_month))
        .groupBy(col(dimension).alias(dimension))
        .agg(of(previous_month).alias("previous"), of(month).alias("current"))
        .withColumn("change", F.col("current") - F.col("previous"))
        .orderBy("change", col(dimension))
    )


def largest_drop(monthly: DataFrame, name: str = "total") -> tuple[str, str] | None:
    """(month, previous month) with the most negative change; None if nothing dropped."""
    order = W.partitionBy(F.lit(0)).orderBy("month")
    row = (
        month_over_month(monthly, name)
        .withColumn("previous_month", F.lag("month").over(order))
        .where(F.col("change") < 0)
        .orderBy("change", "month")
        .first()
    )
    return (row["month"], row["previous_month"]) if row else None
