"""Registration of coverage queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabscope.plans.sql import open_workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return add


def register_sql(name: str, tables: str, spark_sql: str, oracle: str | None = "same") -> None:
    """A query given as SQL text; ``oracle="same"`` when the text suits both engines."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = [table_path(sf_dir, t) for t in tables.split()]
        return open_workspace(spark, paths).sql(spark_sql.replace("{sf_dir}", sf_dir.rstrip("/")))

    register(name, spark_sql if oracle == "same" else oracle)(query)
