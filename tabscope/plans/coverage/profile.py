"""Column statistics, roles, warnings and date coercion over whole tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.coerce import coerce_dates, detect_date_columns
from tabscope.operators.columns import (
    approx_distinct_stats,
    date_ranges,
    distinct_stats,
    missing_stats,
    numeric_stats,
    top_values,
)
from tabscope.operators.duplicates import duplicate_count
from tabscope.operators.quantiles import approximate_quantiles
from tabscope.operators.roles import ROLES, quality_warnings, with_roles
from tabscope.plans.coverage.registry import register, table, table_path
from tabscope.plans.growing import DISTINCT_ERROR, RANK_ERROR, grown_profile
from tabscope.plans.light import light_statistics
from tabscope.plans.profile import compact_profile, inspect_frame, profile_columns, profile_dataset, profile_frame
from tabscope.session import scratch_path

# Column -> Spark type of the tables that the oracles describe.
COLUMNS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
        " l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
NUMERIC_TYPES = ("bigint", "int", "double")


def fields(source: str) -> list[tuple[int, str, str]]:
    return [(i, *c.split()) for i, c in enumerate(COLUMNS[source].split(", "))]


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# --- gaps: a derived table with missing values, a constant and an empty column ---

GAPS_SQL = """(SELECT c_custkey, c_name,
                      CASE WHEN c_nationkey < 8 THEN NULL ELSE c_acctbal END AS c_acctbal,
                      CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_mktsegment END AS c_mktsegment,
                      CASE WHEN c_nationkey = 3 THEN c_name END AS c_rare,
                      CAST(NULL AS VARCHAR) AS c_empty, 'X' AS c_constant
               FROM customer)"""
GAPS_COLUMNS = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_rare", "c_empty", "c_constant"]


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_name",
        F.when(F.col("c_nationkey") >= 8, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_nationkey") == 3, F.col("c_name")).alias("c_rare"),
        F.lit(None).cast("string").alias("c_empty"),
        F.lit("X").alias("c_constant"),
    )


@register(
    "profile_missing",
    union_all(
        f"""SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS name, COUNT(*) - COUNT({c}) AS missing_count,
                   ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS missing_pct FROM {GAPS_SQL} g"""
        for i, c in enumerate(GAPS_COLUMNS)
    ),
)
def profile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_stats(gaps(spark, sf_dir)).drop("dtype")


def _distinct_sql(source: str) -> str:
    return union_all(
        f"SELECT '{source}' AS source, CAST({i} AS INTEGER) AS ordinal, '{c}' AS name, COUNT(DISTINCT {c}) AS unique_count FROM {source}"
        for i, c, _ in fields(source)
    )


@register("profile_distinct", union_all([_distinct_sql(s) for s in ("lineitem", "documents", "events")]))
def profile_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        distinct_stats(table(spark, sf_dir, s)).select(F.lit(s).alias("source"), "*")
        for s in ("lineitem", "documents", "events")
    ]
    return reduce(DataFrame.unionAll, parts)


@register("profile_distinct_approx")
def profile_distinct_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approx_distinct_stats(table(spark, sf_dir, "lineitem"))


STATISTICS = ("min", "max", "mean", "std", "q25", "q50", "q75")


def _numeric_sql(source: str) -> str:
    return union_all(
        f"""SELECT '{c}' AS name, CAST(MIN({c}) AS DOUBLE) AS "min", CAST(MAX({c}) AS DOUBLE) AS "max",
                   ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std,
                   ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25,
                   ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50,
                   ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75 FROM {source}"""
        for _, c, t in fields(source)
        if t in NUMERIC_TYPES
    )


def _rounded(stats: DataFrame) -> DataFrame:
    exact = ("min", "max")
    return stats.select("name", *[F.col(s) if s in exact else F.round(s, 4).alias(s) for s in STATISTICS])


@register("profile_numeric", _numeric_sql("lineitem"))
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(numeric_stats(table(spark, sf_dir, "lineitem")))


@register("profile_numeric_narrowing", _numeric_sql("orders"))
def profile_numeric_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quartile search for large input, forced by low limits."""
    return _rounded(numeric_stats(table(spark, sf_dir, "orders"), leaf_rows=2000, pivot_rows=5000))


@register("profile_quantiles_approx")
def profile_quantiles_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_quantiles(table(spark, sf_dir, "lineitem"))


def _stamp(expr: str) -> str:
    return (
        f"CASE WHEN strftime({expr}, '%f') = '000000' THEN strftime({expr}, '%Y-%m-%d %H:%M:%S')"
        f" ELSE strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') END"
    )


@register(
    "profile_date_range",
    union_all(
        f"SELECT '{c}' AS name, {_stamp(f'MIN({c})')} AS date_min, {_stamp(f'MAX({c})')} AS date_max FROM {s}"
        for s in ("orders", "lineitem", "events")
        for _, c, t in fields(s)
        if t == "timestamp_ntz"
    ),
)
def profile_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [date_ranges(table(spark, sf_dir, s)).drop("ordinal") for s in ("orders", "lineitem", "events")]
    return reduce(DataFrame.unionAll, parts)


def _top_sql(source: str, column: str) -> str:
    return f"""SELECT * FROM (
        SELECT '{column}' AS name, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, v AS value, n AS count
        FROM (SELECT COALESCE(CAST({column} AS VARCHAR), 'None') AS v, COUNT(*) AS n FROM {source} g GROUP BY 1) t)
        WHERE rank <= 5"""


@register(
    "profile_top_values",
    union_all(
        [_top_sql("documents", c) for c in ("text", "lang", "source")]
        + [_top_sql(GAPS_SQL, c) for c in ("c_name", "c_mktsegment", "c_rare", "c_empty", "c_constant")]
        + [_top_sql("events", c) for c in ("event_type", "props")]
    ),
)
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = [table(spark, sf_dir, "documents"), gaps(spark, sf_dir), table(spark, sf_dir, "events")]
    return reduce(DataFrame.unionAll, [top_values(df).drop("ordinal") for df in inputs])


@register(
    "inspect_dataset",
    union_all(
        f"SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS name, '{t}' AS dtype, COUNT(*) AS row_count FROM lineitem"
        for i, c, t in fields("lineitem")
    ),
)
def inspect_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect_frame(table(spark, sf_dir, "lineitem"))


PROFILED = ("customer", "orders", "events", "documents")


@register(
    "profile_table",
    union_all(
        f"SELECT '{s}' AS source, 'parquet' AS file_type, COUNT(*) AS row_count, CAST({len(fields(s))} AS INTEGER) AS column_count,"
        f" COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {s})) AS duplicate_count FROM {s}"
        for s in PROFILED
    ),
)
def profile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    def facts(source: str) -> DataFrame:
        return profile_dataset(spark, table_path(sf_dir, source)).select(
            F.lit(source).alias("source"), "file_type", "row_count", "column_count", "duplicate_count"
        )

    with ThreadPoolExecutor(max_workers=4) as pool:
        return reduce(DataFrame.unionAll, list(pool.map(facts, PROFILED)))


REPEATED_SQL = """(SELECT lang, source, n_chars FROM documents UNION ALL
                   SELECT lang, source, n_chars FROM documents WHERE lang = 'en')"""


@register(
    "profile_duplicates",
    f"""SELECT 'documents' AS source, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {REPEATED_SQL} r)) AS duplicate_count
        FROM {REPEATED_SQL} r
        UNION ALL SELECT 'lineitem', COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) FROM lineitem""",
)
def profile_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", "n_chars")
    repeated = duplicate_count(docs.unionAll(docs.where(F.col("lang") == "en")))
    lines = duplicate_count(table(spark, sf_dir, "lineitem"))
    return repeated.select(F.lit("documents").alias("source"), "*").unionAll(
        lines.select(F.lit("lineitem").alias("source"), "*")
    )


# --- roles and warnings ---------------------------------------------------------


def _roles_sql(source: str) -> str:
    stats = union_all(
        f"SELECT '{source}' AS source, '{c}' AS name, '{t}' AS t, COUNT(*) AS n, COUNT(DISTINCT {c}) AS u FROM {source}"
        for _, c, t in fields(source)
    )
    return f"""SELECT source, name, is_id, regexp_matches(name, '(?i)(target|label|revenue|sales|price|amount|count|score)')
               OR (num AND u > 1 AND u < greatest(n * 0.5, 2)) AS is_target,
               t = 'timestamp_ntz' OR regexp_matches(name, '(?i)(date|day|month|year|time|timestamp)') AS is_date,
               num AND NOT is_id AS is_metric,
               num AND regexp_matches(name, '(?i)(revenue|sales|amount|price|gmv|arr|mrr|income|profit|cost)') AS is_revenue,
               NOT num AND t <> 'timestamp_ntz' AND NOT is_id AND u > 1 AND u <= greatest(n * 0.5, 10) AS is_dimension
        FROM (SELECT *, t IN ('bigint', 'int', 'double') AS num,
                     regexp_matches(name, '(?i)(^id$|_id$|^uuid$|key$)')
                     OR (t IN ('bigint', 'string') AND u = n AND u > 0) AS is_id FROM ({stats}) s) r"""


ROLE_SOURCES = ("customer", "part", "orders", "lineitem", "events", "documents", "conversations")


@register("roles", union_all([_roles_sql(s) for s in ROLE_SOURCES]))
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    def flagged(source: str) -> DataFrame:
        stats, rows = light_statistics(table(spark, sf_dir, source))
        return with_roles(stats, rows).select(F.lit(source).alias("source"), "name", *[f"is_{r}" for r in ROLES])

    with ThreadPoolExecutor(max_workers=4) as pool:
        return reduce(DataFrame.unionAll, list(pool.map(flagged, ROLE_SOURCES)))


GAPS_TWICE_SQL = f"(SELECT * FROM {GAPS_SQL} a UNION ALL SELECT * FROM {GAPS_SQL} b WHERE c_mktsegment = 'BUILDING')"


@register(
    "quality_warnings",
    union_all(
        f"""SELECT position, warning FROM (
              SELECT CAST({2 * i} AS BIGINT) AS position, CASE WHEN p > 50 THEN
                'Column ''{c}'' has ' || printf('%.1f', p) || '% missing values' END AS warning,
                CAST({2 * i} + CASE WHEN p > 50 THEN 1 ELSE 0 END AS BIGINT) AS pos2, u FROM (
                SELECT ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS p, COUNT(DISTINCT {c}) AS u FROM {GAPS_TWICE_SQL} g))
            WHERE warning IS NOT NULL
            UNION ALL
            SELECT CAST({2 * i} + CASE WHEN p > 50 THEN 1 ELSE 0 END AS BIGINT), 'Column ''{c}'' has only one unique value' FROM (
              SELECT ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS p, COUNT(DISTINCT {c}) AS u FROM {GAPS_TWICE_SQL} g)
            WHERE u = 1"""
        for i, c in enumerate(GAPS_COLUMNS)
    )
    + f""" UNION ALL SELECT CAST({2**40} AS BIGINT), 'Found ' || d || ' duplicate rows' FROM (
            SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {GAPS_TWICE_SQL} g)) AS d
            FROM {GAPS_TWICE_SQL} g) WHERE d > 0""",
)
def warnings_of_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = gaps(spark, sf_dir)
    twice = base.unionAll(base.where(F.col("c_mktsegment") == "BUILDING"))
    stats, _ = light_statistics(twice, distinct=False)
    return quality_warnings(stats, duplicate_count(twice))


def _full_sql(source: str) -> str:
    parts = []
    for i, c, t in fields(source):
        numeric = t in NUMERIC_TYPES
        temporal = t == "timestamp_ntz"
        q = f"ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4)" if numeric else "NULL"
        top = "NULL" if numeric or temporal else f"(SELECT value FROM ({_top_sql(source, c)}) WHERE rank = 1)"
        parts.append(
            f"""SELECT COUNT(*) AS row_count,
                       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {source})) AS duplicate_count,
                       CAST({i} AS INTEGER) AS ordinal, '{c}' AS name, COUNT(*) - COUNT({c}) AS missing_count,
                       COUNT(DISTINCT {c}) AS unique_count, {q} AS q50,
                       {_stamp(f'MIN({c})') if temporal else 'NULL'} AS date_min, {top} AS top_value FROM {source}"""
        )
    return union_all(parts)


@register("profile_full", _full_sql("lineitem"))
def profile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-row profile, with a sample, unfolded to one row per column."""
    profile = profile_dataset(spark, table_path(sf_dir, "lineitem"), include_sample=True)
    columns = profile.select("row_count", "duplicate_count", F.inline("columns"))
    return columns.select(
        "row_count",
        "duplicate_count",
        "ordinal",
        "name",
        "missing_count",
        "unique_count",
        F.round("q50", 4).alias("q50"),
        "date_min",
        F.try_element_at("top_values", F.lit(1))["value"].alias("top_value"),
    )


@register(
    "profile_compact",
    union_all(
        f"""SELECT COUNT(*) AS row_count, CAST(7 AS INTEGER) AS column_count, '{c}' AS name,
                   ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS missing_pct, 'c_custkey,c_name' AS id_columns
            FROM {GAPS_SQL} g"""
        for c in GAPS_COLUMNS
    ),
)
def profile_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    compact = compact_profile(profile_frame(gaps(spark, sf_dir), path="customer-gaps"))
    return compact.select(
        "row_count", "column_count", F.explode("columns").alias("c"), F.array_join("id_columns", ",").alias("id_columns")
    ).select("row_count", "column_count", "c.name", "c.missing_pct", "id_columns")


@register(
    "sql_summarize",
    union_all(
        f"""SELECT '{c}' AS name, '{t}' AS dtype, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing_count,
                   COUNT(DISTINCT {c}) AS unique_count, """
        + (
            f'CAST(MIN({c}) AS DOUBLE) AS "min", CAST(MAX({c}) AS DOUBLE) AS "max", ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50'
            if t in NUMERIC_TYPES
            else "NULL, NULL, NULL"
        )
        + " FROM part"
        for _, c, t in fields("part")
    ),
)
def summarize_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SUMMARIZE shows, from the profile operators."""
    stats, _ = profile_columns(table(spark, sf_dir, "part"))
    return stats.select("name", "dtype", "missing_count", "unique_count", "min", "max", F.round("q50", 4).alias("q50"))


# --- date coercion: order dates written in several forms, with bad values --------


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.col("o_orderkey") % 10
    date = F.col("o_orderdate")
    written = (
        F.when(form < 3, F.date_format(date, "yyyy-MM-dd"))
        .when(form < 5, F.date_format(date, "M/d/yyyy"))
        .when(form < 6, F.date_format(date, "d MMM yyyy"))
        .when(form < 7, F.date_format(date, "yyyyMMdd"))
        .when(form < 8, F.date_format(date, "yyyy-MM-dd HH:mm:ss"))
        .when(form < 9, F.date_format(date, "MMM d yyyy"))
        .otherwise(F.lit("not known"))
    )
    half = F.when(form < 5, F.date_format(date, "yyyy-MM-dd")).otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", written.alias("mostly_dates"), half.alias("half_dates"), "o_orderpriority"
    )


@register(
    "date_coerce",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE o_orderdate END AS mostly_dates,
              CASE WHEN o_orderkey % 10 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderstatus END AS half_dates,
              o_orderpriority FROM orders""",
)
def date_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = written_dates(spark, sf_dir)
    return coerce_dates(df, detect_date_columns(df, order_by=["o_orderkey"]))


@register(
    "date_coerce_forms",
    """SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS half_days, CAST(o_orderdate AS TIMESTAMP) AS with_seconds,
              CAST(o_orderdate AS TIMESTAMP) AS dotted, CAST(o_orderdate AS TIMESTAMP) AS short_year,
              CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS months,
              CAST(o_orderdate AS TIMESTAMP) AS worded, CAST(o_orderdate AS TIMESTAMP) AS weekdays FROM orders""",
)
def date_coerce_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in further written forms, read back."""
    forms = {
        "half_days": "M/d/yyyy h:mm a", "with_seconds": "yyyy-MM-dd hh:mm:ss a", "dotted": "MM.dd.yyyy",
        "short_year": "MM/dd/yy", "months": "MMM yyyy", "worded": "d MMMM yyyy HH:mm",
        "weekdays": "EEE, d MMM yyyy HH:mm:ss",
    }
    written = [F.date_format(F.col("o_orderdate").cast("timestamp"), form).alias(name) for name, form in forms.items()]
    df = table(spark, sf_dir, "orders").select("o_orderkey", *written)
    return coerce_dates(df, detect_date_columns(df, order_by=["o_orderkey"]))


@register(
    "date_coerce_missing",
    """SELECT 'mostly_dates' AS name, COUNT(*) FILTER (WHERE o_orderkey % 10 = 9) AS missing_count,
              ROUND(COUNT(*) FILTER (WHERE o_orderkey % 10 = 9) * 100.0 / COUNT(*), 2) AS missing_pct FROM orders
       UNION ALL SELECT c, 0, 0.0 FROM (VALUES ('o_orderkey'), ('half_dates'), ('o_orderpriority')) v(c)""",
)
def date_coerce_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that do not parse count as missing."""
    df = written_dates(spark, sf_dir)
    typed = coerce_dates(df, detect_date_columns(df, order_by=["o_orderkey"]))
    return missing_stats(typed).select("name", "missing_count", "missing_pct")


GROWN = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@register(
    "profile_grown",
    union_all(
        f"""SELECT '{c}' AS name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS missing_count,
                   {f'CAST(MIN({c}) AS DOUBLE)' if c in GROWN[:2] + GROWN[3:4] else 'NULL'} AS min,
                   {_stamp(f'MAX({c})') if c == 'o_orderdate' else 'NULL'} AS date_max, TRUE AS distinct_within_error,
                   TRUE AS quartiles_within_error, 1 AS files_scanned FROM orders"""
        for c in GROWN
    ),
)
def profile_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in two steps: the second one scans the new file only, and estimates stay within their errors."""
    data, store = scratch_path(spark, "grown"), scratch_path(spark, "sketches")
    orders = table(spark, sf_dir, "orders")
    orders.where("o_orderkey % 4 < 3").write.parquet(data)
    grown_profile(spark, data, store)
    orders.where("o_orderkey % 4 = 3").coalesce(1).write.mode("append").parquet(data)
    found = grown_profile(spark, data, store)
    exact = distinct_stats(orders).select("name", F.col("unique_count").alias("exact"))
    quartiles = ("q25", "q50", "q75")
    numeric = {r["name"]: r for r in found.columns.where("kind = 'numeric'").collect()}
    ranks = [
        F.avg((F.col(c).cast("double") <= r[q]).cast("double")).alias(f"{c}_{q}") for c, r in numeric.items() for q in quartiles
    ] + [F.avg((F.col(c).cast("double") < r[q]).cast("double")).alias(f"{c}_{q}_below") for c, r in numeric.items() for q in quartiles]
    seen = orders.agg(*ranks).first()
    good = {
        c: all(seen[f"{c}_{q}_below"] - 2 * RANK_ERROR <= t <= seen[f"{c}_{q}"] + 2 * RANK_ERROR for q, t in zip(quartiles, (0.25, 0.5, 0.75)))
        for c in numeric
    }
    wrong = [c for c, ok in good.items() if not ok]
    off = F.abs(F.col("unique_count") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * DISTINCT_ERROR * F.col("exact"))
    return found.columns.join(exact, "name").select(
        "name",
        F.lit(found.rows).cast("bigint").alias("row_count"),
        "missing_count",
        "min",
        "date_max",
        off.alias("distinct_within_error"),
        (~F.col("name").isin(wrong)).alias("quartiles_within_error"),
        F.lit(len(found.scanned)).alias("files_scanned"),
    )
