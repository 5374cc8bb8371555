"""Monthly trends, month-over-month changes and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.trend import (
    change_by_dimension,
    largest_drop,
    metric_by_dimension,
    month_over_month,
    monthly_sum,
)
from tabscope.plans.coverage.registry import register, table, table_path
from tabscope.plans.trend import dataset_trend


def money(name: str) -> Column:
    """Exact cents, so that the sum does not depend on the order of rows."""
    return F.col(name).cast("decimal(18,2)")


def _monthly_oracle(source: str, date: str, metric: str) -> str:
    return (
        f"SELECT strftime({date}, '%Y-%m') AS month, CAST(SUM(CAST({metric} AS DECIMAL(18,2))) AS DOUBLE) AS total"
        f" FROM {source} WHERE {date} IS NOT NULL AND {metric} IS NOT NULL GROUP BY 1 ORDER BY 1"
    )


INPUTS = {
    "orders": ("o_orderdate", "o_totalprice"),
    "lineitem": ("l_shipdate", "l_extendedprice"),
    "events": ("ts", "value"),
}


def _register_trend(source: str, date: str, metric: str) -> None:
    @register(f"monthly_trend_{source}", _monthly_oracle(source, date, metric))
    def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
        monthly = monthly_sum(table(spark, sf_dir, source), date, money(metric))
        return monthly.withColumn("total", F.col("total").cast("double"))


for _source, (_date, _metric) in INPUTS.items():
    _register_trend(_source, _date, _metric)


@register(
    "dataset_trend",
    """SELECT strftime(l_shipdate, '%Y-%m') AS month,
              CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1""",
)
def trend_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns are chosen from the roles: ship date and extended price."""
    trend = dataset_trend(spark, table_path(sf_dir, "lineitem"))
    return trend.withColumn("total", F.round("total", 2))


MONTHS = """SELECT strftime(o_orderdate, '%Y-%m') AS month, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total
            FROM orders GROUP BY 1"""


@register(
    "mom_change",
    f"""SELECT month, CAST(total AS DOUBLE) AS total, CAST(previous AS DOUBLE) AS previous,
               CAST(total - previous AS DOUBLE) AS change,
               ROUND(CAST(total - previous AS DOUBLE) * 100 / CAST(previous AS DOUBLE), 4) AS change_pct
        FROM (SELECT month, total, LAG(total) OVER (ORDER BY month) AS previous FROM ({MONTHS}) m)""",
)
def mom_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = monthly_sum(table(spark, sf_dir, "orders"), "o_orderdate", money("o_totalprice"))
    changes = month_over_month(monthly.withColumn("total", F.col("total").cast("decimal(28,2)")))
    pct = F.round(F.col("change").cast("double") * 100 / F.col("previous").cast("double"), 4)
    return changes.select(
        "month",
        F.col("total").cast("double").alias("total"),
        F.col("previous").cast("double").alias("previous"),
        F.col("change").cast("double").alias("change"),
        pct.alias("change_pct"),
    )


@register(
    "drop_by_dimension",
    f"""WITH m AS (SELECT month, total, LAG(month) OVER (ORDER BY month) AS prev_month,
                          total - LAG(total) OVER (ORDER BY month) AS change FROM ({MONTHS}) t),
             d AS (SELECT month, prev_month FROM m WHERE change < 0 ORDER BY change, month LIMIT 1),
             x AS (SELECT o_orderpriority,
                          COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2)))
                                   FILTER (WHERE strftime(o_orderdate, '%Y-%m') = (SELECT prev_month FROM d)), 0) AS previous,
                          COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2)))
                                   FILTER (WHERE strftime(o_orderdate, '%Y-%m') = (SELECT month FROM d)), 0) AS current
                   FROM orders
                   WHERE strftime(o_orderdate, '%Y-%m') IN (SELECT month FROM d UNION SELECT prev_month FROM d)
                   GROUP BY 1)
        SELECT o_orderpriority, CAST(previous AS DOUBLE) AS previous, CAST(current AS DOUBLE) AS current,
               CAST(current - previous AS DOUBLE) AS change FROM x""",
)
def drop_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which order priorities made up the largest monthly drop."""
    orders = table(spark, sf_dir, "orders")
    monthly = monthly_sum(orders, "o_orderdate", money("o_totalprice"))
    month, previous = largest_drop(monthly) or ("0001-02", "0001-01")
    changes = change_by_dimension(
        orders, "o_orderdate", money("o_totalprice"), "o_orderpriority", month, previous
    )
    return changes.select(
        "o_orderpriority", *[F.col(c).cast("double").alias(c) for c in ("previous", "current", "change")]
    )


@register(
    "metric_by_dimension",
    """SELECT o_orderpriority, CAST(total AS DOUBLE) AS total,
              ROUND(CAST(total AS DOUBLE) / CAST((SELECT SUM(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) AS DOUBLE), 6) AS share
       FROM (SELECT o_orderpriority, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1) t""",
)
def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = metric_by_dimension(table(spark, sf_dir, "orders"), "o_orderpriority", money("o_totalprice"))
    return result.select("o_orderpriority", F.col("total").cast("double").alias("total"), F.round("share", 6).alias("share"))
