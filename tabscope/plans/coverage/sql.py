"""The relational surface behind SQL over files.

Windows run over pre-aggregated rows or keep a constant number of rows per group,
so no window task holds all rows of a hot key. Exact percentiles and lists are
taken over columns with a small fixed domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.asof import asof_join
from tabscope.operators.interval import interval_join, interval_totals, overlap_join
from tabscope.operators.sample import exact_sample
from tabscope.operators.scan import running
from tabscope.plans.coverage.registry import register, register_sql, table, table_path
from tabscope.plans.sql import open_workspace
from tabscope.session import scratch_path

# --- projection ---------------------------------------------------------------

register_sql(
    "sql_project",
    "orders",
    """SELECT o_orderkey, o_totalprice * 0.1 AS tenth, CAST(o_orderdate AS DATE) AS order_day,
              upper(o_orderpriority) AS priority
       FROM orders""",
)
register_sql(
    "sql_case",
    "lineitem",
    """SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS bucket,
              COUNT(*) AS n
       FROM lineitem GROUP BY 1""",
)
register_sql("sql_distinct", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
register_sql(
    "sql_star_except",
    "customer",
    "SELECT * EXCEPT (c_acctbal, c_name) FROM customer",
    "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
)

# --- filter -------------------------------------------------------------------

register_sql(
    "sql_filter",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'
         AND l_discount BETWEEN 0.05 AND 0.07 AND (l_returnflag IN ('A', 'R') OR NOT l_linestatus = 'O')
         AND l_tax IS NOT NULL""",
)
register_sql(
    "sql_like",
    "part",
    r"""SELECT p_partkey, p_name, p_brand FROM part
        WHERE (p_name LIKE '%ring' OR p_type ILIKE 'econ%') AND NOT p_brand LIKE '%#1_'
          AND p_name RLIKE '^(small|red|blue|large)'""",
    r"""SELECT p_partkey, p_name, p_brand FROM part
        WHERE (p_name LIKE '%ring' OR p_type ILIKE 'econ%') AND NOT p_brand LIKE '%#1_'
          AND regexp_matches(p_name, '^(small|red|blue|large)')""",
)

# --- joins --------------------------------------------------------------------
# Lines are summed per order before the join, so an order with very many lines
# reaches it as one row.

register_sql(
    "sql_join_inner",
    "orders lineitem",
    """SELECT o_orderstatus, COUNT(*) AS n_orders, CAST(SUM(revenue) AS DOUBLE) AS revenue
       FROM orders JOIN (
         SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue FROM lineitem GROUP BY l_orderkey
       ) l ON o_orderkey = l_orderkey
       GROUP BY o_orderstatus""",
)
register_sql(
    "sql_join_left",
    "customer orders",
    """SELECT c_mktsegment, COUNT(*) AS customers, CAST(SUM(COALESCE(n, 0)) AS BIGINT) AS orders,
              COUNT(CASE WHEN n IS NULL THEN 1 END) AS without_orders
       FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) o
         ON c_custkey = o_custkey
       GROUP BY c_mktsegment""",
)
register_sql(
    "sql_join_right",
    "orders lineitem",
    """SELECT o_orderpriority, COUNT(*) AS n_orders, CAST(SUM(lines) AS BIGINT) AS lines
       FROM (SELECT l_orderkey, COUNT(*) AS lines FROM lineitem GROUP BY l_orderkey) l
       RIGHT JOIN orders ON o_orderkey = l_orderkey
       GROUP BY o_orderpriority""",
)
register_sql(
    "sql_join_full",
    "supplier customer",
    """SELECT COALESCE(s_nationkey, c_nationkey) AS nationkey, suppliers, customers
       FROM (SELECT s_nationkey, COUNT(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s
       FULL JOIN (SELECT c_nationkey, COUNT(*) AS customers FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey) c
         ON s_nationkey = c_nationkey""",
)
# Customers and nations are broadcast by the planner only while under its size threshold.
register_sql(
    "sql_join_star",
    "region nation customer orders",
    """SELECT r_name, n_name, COUNT(*) AS n_customers, CAST(SUM(spent) AS DOUBLE) AS spent
       FROM (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS spent FROM orders GROUP BY o_custkey) o
       JOIN customer ON c_custkey = o_custkey
       JOIN nation ON n_nationkey = c_nationkey
       JOIN region ON r_regionkey = n_regionkey
       GROUP BY r_name, n_name""",
)
# The keys are made distinct first: a customer with very many orders is one key.
register_sql(
    "sql_join_semi",
    "customer orders",
    """SELECT c_custkey, c_mktsegment FROM customer
       WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) o
                     WHERE o_custkey = c_custkey)""",
)
register_sql(
    "sql_join_anti",
    "customer orders",
    """SELECT c_custkey, c_mktsegment FROM customer
       WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) o
                     WHERE o_custkey = c_custkey)""",
)
# A range condition gets an equality on the band number, so it is no nested loop. Lines
# collapse to one row per price first, so a band holds prices, not lines.
register_sql(
    "sql_join_range",
    "orders lineitem",
    """WITH bands AS (
         SELECT CAST(FLOOR(o_totalprice / 20000) AS BIGINT) AS band,
                FLOOR(o_totalprice / 20000) * 20000 AS low, FLOOR(o_totalprice / 20000) * 20000 + 20000 AS high,
                COUNT(*) AS orders_in_band
         FROM orders GROUP BY 1, 2, 3)
       SELECT band, MAX(orders_in_band) AS orders_in_band, SUM(lines) AS lines_in_band
       FROM (SELECT l_extendedprice, COUNT(*) AS lines FROM lineitem GROUP BY l_extendedprice) JOIN bands
         ON band = CAST(FLOOR(l_extendedprice / 20000) AS BIGINT) AND l_extendedprice >= low AND l_extendedprice < high
       GROUP BY band""",
    """WITH bands AS (
         SELECT CAST(FLOOR(o_totalprice / 20000) AS BIGINT) AS band,
                FLOOR(o_totalprice / 20000) * 20000 AS low, FLOOR(o_totalprice / 20000) * 20000 + 20000 AS high,
                COUNT(*) AS orders_in_band
         FROM orders GROUP BY 1, 2, 3)
       SELECT band, MAX(orders_in_band) AS orders_in_band, COUNT(*) AS lines_in_band
       FROM lineitem JOIN bands ON l_extendedprice >= low AND l_extendedprice < high
       GROUP BY band""",
)


@register(
    "sql_join_interval",
    """SELECT o_orderkey, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty
       FROM orders JOIN lineitem
         ON l_extendedprice >= o_totalprice * 0.2
        AND l_extendedprice < o_totalprice * 0.2 + CASE WHEN o_orderkey % 1000 = 0 THEN 2000 ELSE (o_orderkey % 7) * 0.5 END
       GROUP BY o_orderkey""",
)
def sql_join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_totalprice * 0.2 AS low",
        "o_totalprice * 0.2 + CASE WHEN o_orderkey % 1000 = 0 THEN 2000 ELSE (o_orderkey % 7) * 0.5 END AS high",
    )
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", F.col("l_quantity").cast("decimal(18,2)"))
    totals = interval_totals(lines, orders, "l_extendedprice", "low", "high", ["o_orderkey"], "n", {"qty": "l_quantity"})
    return totals.withColumn("qty", F.col("qty").cast("double"))


@register(
    "sql_join_overlap",
    """SELECT c_custkey, p_partkey FROM customer JOIN part
         ON c_acctbal <= p_retailprice + p_size * 0.05 AND p_retailprice <= c_acctbal + c_custkey % 5""",
)
def sql_join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal AS c_low", "c_acctbal + c_custkey % 5 AS c_high")
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_retailprice AS p_low", "p_retailprice + p_size * 0.05 AS p_high")
    pairs = overlap_join(customers, parts, ("c_low", "c_high"), ("p_low", "p_high"))
    return pairs.select("c_custkey", "p_partkey")


@register(
    "sql_join_within",
    """SELECT c.event_id, c.user_id, c.ts, COUNT(p.event_id) AS purchases
       FROM (SELECT * FROM events WHERE event_type = 'click') c
       LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
         ON p.user_id = c.user_id AND c.ts > p.ts AND c.ts <= p.ts + INTERVAL 6 HOUR
       GROUP BY c.event_id, c.user_id, c.ts""",
)
def sql_join_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    after = events.where("event_type = 'purchase'").selectExpr("event_id AS purchase_id", "user_id", "ts AS since", "ts + INTERVAL 6 HOUR AS until")
    pairs = interval_join(clicks, after, "ts", "since", "until", keys=["user_id"], closed="right", how="left")
    return pairs.groupBy("event_id", "user_id", "ts").agg(F.count("purchase_id").alias("purchases"))


register_sql(
    "sql_join_self",
    "events",
    """SELECT a.event_type AS event_type, b.event_type AS next_type, COUNT(*) AS n
       FROM events a JOIN events b ON b.event_id = a.event_id + 1
       GROUP BY a.event_type, b.event_type""",
)
register_sql(
    "sql_lateral",
    "nation customer",
    """SELECT n_name, n_customers, richest
       FROM nation, LATERAL (SELECT COUNT(*) AS n_customers, MAX(c_acctbal) AS richest
                             FROM customer WHERE c_nationkey = n_nationkey) c""",
)


@register(
    "sql_asof",
    """SELECT e.event_id, e.user_id, c.event_id AS asof_event_id, c.value AS asof_value
       FROM (SELECT * FROM events WHERE event_type = 'purchase') e
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
         ON e.user_id = c.user_id AND e.ts >= c.ts""",
)
def sql_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    purchases = events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    clicks = events.where(F.col("event_type") == "click").select("event_id", "user_id", "ts", "value")
    joined = asof_join(purchases, clicks, "user_id", "ts", ["event_id", "value"])
    return joined.select("event_id", "user_id", "asof_event_id", "asof_value")


# --- aggregation --------------------------------------------------------------

register_sql(
    "sql_agg_basic",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
              CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
              ROUND(AVG(l_discount), 6) AS avg_discount, MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship,
              ROUND(STDDEV_SAMP(l_quantity), 4) AS sd_qty, ROUND(VAR_POP(l_tax), 6) AS var_tax
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
register_sql(
    "sql_having",
    "orders",
    """SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS largest FROM orders
       GROUP BY o_custkey HAVING COUNT(*) >= 12""",
)
register_sql(
    "sql_agg_filter",
    "lineitem",
    """SELECT l_linestatus, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS returned,
              CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_discount > 0.05) AS DOUBLE) AS discounted
       FROM lineitem GROUP BY ALL""",
)
register_sql(
    "sql_count_distinct",
    "lineitem",
    """SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers
       FROM lineitem GROUP BY l_returnflag""",
)
register_sql(
    "sql_approx_distinct",
    "lineitem",
    """SELECT l_returnflag, approx_count_distinct(l_orderkey, 0.02) AS approx_orders
       FROM lineitem GROUP BY l_returnflag""",
    None,
)
register_sql(
    "sql_rollup",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, GROUPING(l_linestatus) AS g FROM lineitem
       GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
register_sql(
    "sql_cube",
    "orders",
    """SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders
       GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
)
register_sql(
    "sql_grouping_sets",
    "orders",
    """SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS largest FROM orders
       GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
)
register_sql(
    "sql_ordinal",
    "orders",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
              CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM orders GROUP BY 1 ORDER BY 2 DESC""",
)
# The percentile state holds one entry per distinct value: 50 quantities, 11 discounts.
register_sql(
    "sql_quantile",
    "lineitem",
    """SELECT l_returnflag, percentile(l_quantity, 0.25) AS q25, median(l_quantity) AS q50,
              percentile(l_quantity, 0.9) AS q90, median(l_discount) AS median_discount
       FROM lineitem GROUP BY l_returnflag""",
    """SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q25, median(l_quantity) AS q50,
              quantile_cont(l_quantity, 0.9) AS q90, median(l_discount) AS median_discount
       FROM lineitem GROUP BY l_returnflag""",
)
register_sql(
    "sql_mode",
    "documents",
    "SELECT source, mode() WITHIN GROUP (ORDER BY lang) AS usual_lang FROM documents GROUP BY source",
    # mode() takes any of several equally frequent values there; here the least one counts.
    """SELECT source, lang AS usual_lang FROM (SELECT source, lang, COUNT(*) AS n FROM documents GROUP BY ALL)
       QUALIFY ROW_NUMBER() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1""",
)
register_sql(
    "sql_arg_max",
    "orders",
    """SELECT o_orderstatus, MAX_BY(o_orderkey, struct(o_totalprice, o_orderkey)) AS key_of_largest,
              MIN_BY(o_orderkey, struct(o_totalprice, o_orderkey)) AS key_of_smallest
       FROM orders GROUP BY o_orderstatus""",
    """SELECT o_orderstatus, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS key_of_largest,
              arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS key_of_smallest
       FROM orders GROUP BY o_orderstatus""",
)
# Lists are built from distinct values of small domains, never from raw rows.
register_sql(
    "sql_string_agg",
    "part",
    """SELECT p_type, string_agg(p_brand, ',') WITHIN GROUP (ORDER BY p_brand) AS brands
       FROM (SELECT DISTINCT p_type, p_brand FROM part) p GROUP BY p_type""",
    """SELECT p_type, string_agg(p_brand, ',' ORDER BY p_brand) AS brands
       FROM (SELECT DISTINCT p_type, p_brand FROM part) p GROUP BY p_type""",
)
register_sql(
    "sql_list_agg",
    "customer",
    """SELECT c_nationkey, array_join(sort_array(collect_list(c_mktsegment)), '|') AS segments, CAST(size(collect_list(c_mktsegment)) AS BIGINT) AS n
       FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) c GROUP BY c_nationkey""",
    """SELECT c_nationkey, array_to_string(list_sort(list(c_mktsegment)), '|') AS segments, len(list(c_mktsegment)) AS n
       FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) c GROUP BY c_nationkey""",
)
register_sql(
    "sql_pivot",
    "lineitem",
    """SELECT * FROM (SELECT year(l_shipdate) AS ship_year, l_returnflag, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM lineitem)
       PIVOT (CAST(SUM(q) AS DOUBLE) FOR l_returnflag IN ('A' AS qty_a, 'N' AS qty_n, 'R' AS qty_r))""",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year,
              CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS qty_a,
              CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'N') AS DOUBLE) AS qty_n,
              CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS qty_r
       FROM lineitem GROUP BY 1""",
)
register_sql(
    "sql_unpivot",
    "lineitem",
    """SELECT rate_name, COUNT(*) AS n, MAX(rate) AS largest
       FROM (SELECT l_discount, l_tax FROM lineitem) UNPIVOT (rate FOR rate_name IN (l_discount, l_tax))
       GROUP BY rate_name""",
    """SELECT 'l_discount' AS rate_name, COUNT(*) AS n, MAX(l_discount) AS largest FROM lineitem
       UNION ALL SELECT 'l_tax', COUNT(*), MAX(l_tax) FROM lineitem""",
)

# --- windows, over monthly totals ---------------------------------------------

MONTHLY = """(SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
                     SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty, COUNT(*) AS n
              FROM lineitem GROUP BY 1, 2) m"""
register_sql(
    "sql_win_rank",
    "lineitem",
    f"""SELECT l_returnflag, month, ROW_NUMBER() OVER w AS rn, RANK() OVER w AS rk, DENSE_RANK() OVER w AS dr,
               NTILE(4) OVER w AS quarter, ROUND(PERCENT_RANK() OVER w, 6) AS pr, ROUND(CUME_DIST() OVER w, 6) AS cd
        FROM {MONTHLY} WINDOW w AS (PARTITION BY l_returnflag ORDER BY qty DESC, month)""",
)
register_sql(
    "sql_win_analytic",
    "lineitem",
    f"""SELECT l_returnflag, month, LAG(n) OVER w AS prev_n, LEAD(n, 2) OVER w AS next2_n,
               FIRST_VALUE(n) OVER w AS first_n,
               LAST_VALUE(n) OVER (PARTITION BY l_returnflag ORDER BY month
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_n,
               NTH_VALUE(n, 3) OVER w AS third_n
        FROM {MONTHLY} WINDOW w AS (PARTITION BY l_returnflag ORDER BY month)""",
)
register_sql(
    "sql_win_frame",
    "lineitem",
    f"""SELECT l_returnflag, month,
               CAST(SUM(qty) OVER (PARTITION BY l_returnflag ORDER BY month) AS DOUBLE) AS running,
               CAST(SUM(qty) OVER (PARTITION BY l_returnflag ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last3,
               CAST(SUM(n) OVER (PARTITION BY l_returnflag ORDER BY month
                                 RANGE BETWEEN INTERVAL 3 MONTH PRECEDING AND CURRENT ROW) AS BIGINT) AS quarter_n
        FROM {MONTHLY}""",
)


@register(
    "sql_win_running",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
              CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) OVER w AS DOUBLE) AS qty, COUNT(*) OVER w AS n,
              MAX(l_extendedprice) OVER w AS dearest
       FROM lineitem
       WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def sql_win_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals over three keys that hold all rows: parts of them, not whole keys, meet in a task."""
    lines = table(spark, sf_dir, "lineitem").withColumn("_qty", F.col("l_quantity").cast("decimal(18,2)")).withColumn("_one", F.lit(1))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    values = {"qty": ("sum", "_qty"), "n": ("count", "_one"), "dearest": ("max", "l_extendedprice")}
    totals = running(lines, ["l_returnflag"], order, values, part_rows=100_000)
    return totals.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.col("qty").cast("double").alias("qty"), "n", "dearest")


# row_number() = 1 is cut to one row per key and task before the shuffle.
register_sql(
    "sql_qualify",
    "orders",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders
       ) WHERE rn = 1""",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
       QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""",
)
register_sql(
    "sql_distinct_on",
    "events",
    """SELECT user_id, event_id, event_type FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
       ) WHERE rn = 1""",
    "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC",
)

# --- sort, limit, sample ------------------------------------------------------

register_sql(
    "sql_topk",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25""",
)
register_sql(
    "sql_limit_offset",
    "orders",
    "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate NULLS LAST, o_orderkey LIMIT 20 OFFSET 40",
)
register_sql(
    "sql_nulls_order",
    "orders",
    """SELECT o_orderkey, small FROM (
         SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN o_totalprice END AS small FROM orders)
       ORDER BY small DESC NULLS LAST, o_orderkey LIMIT 30""",
)
register_sql("sql_sample", "lineitem", "SELECT * FROM lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (7)", None)


SAMPLE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@register(
    "sql_sample_rows",
    f"""SELECT {', '.join(SAMPLE_KEYS)} FROM lineitem
        ORDER BY md5('7' || chr(31) || {" || chr(31) || ".join(SAMPLE_KEYS)}), {', '.join(SAMPLE_KEYS)} LIMIT 500""",
)
def sql_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``USING SAMPLE 500 ROWS``, the same 500 in every run."""
    return exact_sample(table(spark, sf_dir, "lineitem").select(*SAMPLE_KEYS), 500, seed=7)


# --- set operations -----------------------------------------------------------

BIG, URGENT = "o_totalprice > 250000", "o_orderpriority = '1-URGENT'"
# INTERSECT and EXCEPT join their sides, so each side is made distinct before.
for name, op, what in (
    ("sql_union", "UNION", ""),
    ("sql_union_all", "UNION ALL", ""),
    ("sql_intersect", "INTERSECT", "DISTINCT"),
    ("sql_intersect_all", "INTERSECT ALL", ""),
    ("sql_except", "EXCEPT", "DISTINCT"),
    ("sql_except_all", "EXCEPT ALL", ""),
):
    register_sql(
        name,
        "orders",
        f"SELECT {what} o_custkey FROM orders WHERE {BIG} {op} SELECT {what} o_custkey FROM orders WHERE {URGENT}",
    )


@register(
    "sql_union_by_name",
    """SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer
       UNION ALL BY NAME SELECT s_nationkey AS nation, s_suppkey AS id FROM supplier""",
)
def sql_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey id", "c_nationkey nation", "c_mktsegment segment")
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_nationkey nation", "s_suppkey id")
    return customers.unionByName(suppliers, allowMissingColumns=True)


# --- subqueries and CTEs ------------------------------------------------------

register_sql(
    "sql_subquery_scalar",
    "part",
    "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)",
)
# The outer side has one row per customer and the inner side is aggregated per
# customer, so the join that Spark makes of it meets no hot key.
register_sql(
    "sql_subquery_corr",
    "customer orders",
    """SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest
       FROM customer
       WHERE c_acctbal > (SELECT AVG(o_totalprice) / 50 FROM orders WHERE o_custkey = c_custkey)""",
)
register_sql(
    "sql_subquery_in",
    "supplier nation region",
    """SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (
         SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%'))""",
)
register_sql(
    "sql_cte",
    "orders customer",
    """WITH spent AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey),
            seg AS (SELECT c_mktsegment, total FROM customer JOIN spent ON c_custkey = o_custkey)
       SELECT c_mktsegment, COUNT(*) AS n, CAST(MAX(total) AS DOUBLE) AS best FROM seg GROUP BY c_mktsegment""",
)
register_sql(
    "sql_cte_recursive",
    "orders",
    """WITH RECURSIVE spans AS (SELECT MIN(year(o_orderdate)) AS lo, MAX(year(o_orderdate)) AS hi FROM orders),
            years(y, hi) AS (
              SELECT CAST(lo AS BIGINT), CAST(hi AS BIGINT) FROM spans
              UNION ALL SELECT y + 1, hi FROM years WHERE y < hi)
       SELECT y, COALESCE(n, 0) AS n FROM years
       LEFT JOIN (SELECT CAST(year(o_orderdate) AS BIGINT) AS oy, COUNT(*) AS n FROM orders GROUP BY 1) o ON oy = y""",
)

# --- scalar functions ---------------------------------------------------------

register_sql(
    "sql_fn_string",
    "customer",
    """SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, trim(concat('  ', c_name, ' ')) AS tr,
              substr(c_name, 10, 4) AS sub, length(c_name) AS len, replace(c_name, '#', '-') AS rep,
              split(c_name, '#')[1] AS part2, regexp_replace(c_name, '0+', 'o') AS rr,
              regexp_extract(c_name, '([0-9]+)', 1) AS digits, concat(c_mktsegment, '/', c_name) AS cc,
              left(c_name, 3) AS le, lpad(CAST(c_nationkey AS STRING), 4, '0') AS lp, instr(c_name, '#') AS pos,
              reverse(c_mktsegment) AS rv
       FROM customer""",
    """SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, trim(concat('  ', c_name, ' ')) AS tr,
              substr(c_name, 10, 4) AS sub, length(c_name) AS len, replace(c_name, '#', '-') AS rep,
              split(c_name, '#')[2] AS part2, regexp_replace(c_name, '0+', 'o', 'g') AS rr,
              regexp_extract(c_name, '([0-9]+)', 1) AS digits, concat(c_mktsegment, '/', c_name) AS cc,
              left(c_name, 3) AS le, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS lp, instr(c_name, '#') AS pos,
              reverse(c_mktsegment) AS rv
       FROM customer""",
)
register_sql(
    "sql_fn_date",
    "orders",
    """SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start,
              CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(date_part('month', o_orderdate) AS INT) AS m,
              CAST(datediff(o_orderdate, TIMESTAMP_NTZ '1995-01-01 00:00:00') AS BIGINT) AS days,
              CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month, date_format(o_orderdate, 'yyyy-MM') AS ym,
              unix_timestamp(o_orderdate) AS epoch, CAST(dayofyear(o_orderdate) AS INT) AS doy,
              last_day(o_orderdate) AS month_end
       FROM orders""",
    """SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start,
              CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(date_part('month', o_orderdate) AS INT) AS m,
              date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days,
              CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month, strftime(o_orderdate, '%Y-%m') AS ym,
              CAST(epoch(o_orderdate) AS BIGINT) AS epoch, CAST(dayofyear(o_orderdate) AS INT) AS doy,
              last_day(o_orderdate) AS month_end
       FROM orders""",
)
register_sql(
    "sql_fn_math",
    "lineitem",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 7, 2) AS r, abs(l_tax - l_discount) AS a,
              CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c,
              round(power(l_quantity, 2), 2) AS p, round(ln(l_quantity), 6) AS l, round(sqrt(l_quantity), 6) AS s,
              mod(l_orderkey, 7) AS m, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS le,
              coalesce(nullif(l_linenumber, 1), 0) AS n
       FROM lineitem""",
)
register_sql(
    "sql_fn_array",
    "embeddings",
    """SELECT vec_id, element_at(embedding, 1) AS first_value, CAST(size(embedding) AS BIGINT) AS n,
              round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0D, (a, x) -> a + x), 4) AS norm2,
              round(array_max(transform(slice(embedding, 2, 3), x -> CAST(x AS DOUBLE))), 6) AS top_of_slice,
              CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS positive
       FROM embeddings""",
    """SELECT vec_id, embedding[1] AS first_value, len(embedding) AS n,
              round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm2,
              round(list_max(list_transform(embedding[2:4], lambda x: CAST(x AS DOUBLE))), 6) AS top_of_slice,
              len(list_filter(embedding, lambda x: x > 0)) AS positive
       FROM embeddings""",
)
register_sql(
    "sql_explode",
    "embeddings",
    """SELECT CAST(pos AS BIGINT) AS pos, COUNT(*) AS n, MAX(x) AS largest
       FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x GROUP BY pos""",
    """SELECT pos, COUNT(*) AS n, MAX(x) AS largest
       FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
       GROUP BY pos""",
)
register_sql(
    "sql_fn_map_struct",
    "customer",
    """SELECT c_custkey, map('bal', c_acctbal, 'nat', CAST(c_nationkey AS DOUBLE))['nat'] AS nat,
              named_struct('seg', c_mktsegment, 'key', c_custkey).seg AS seg,
              array_join(map_keys(map('a', 1, 'b', 2)), ',') AS keys
       FROM customer""",
    """SELECT c_custkey, map {'bal': c_acctbal, 'nat': CAST(c_nationkey AS DOUBLE)}['nat'] AS nat,
              {'seg': c_mktsegment, 'key': c_custkey}.seg AS seg,
              array_to_string(map_keys(map {'a': 1, 'b': 2}), ',') AS keys
       FROM customer""",
)
register_sql(
    "sql_fn_json",
    "events",
    """SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k,
              from_json(props, 'k BIGINT').k + 1 AS k1 FROM events""",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
              CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k1 FROM events""",
)

# --- files inside SQL text, row counts, written tables ------------------------

register_sql(
    "sql_direct_file",
    "",
    "SELECT n_regionkey, COUNT(*) AS n FROM parquet.`{sf_dir}/nation.parquet` JOIN parquet.`{sf_dir}/customer.parquet` ON c_nationkey = n_nationkey GROUP BY n_regionkey",
    "SELECT n_regionkey, COUNT(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey",
)


@register(
    "sql_row_count",
    "SELECT COUNT(*) AS row_count FROM (SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_quantity > 25) q",
)
def sql_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_quantity > 25;"
    df = open_workspace(spark, table_path(sf_dir, "lineitem")).sql(query)
    return df.agg(F.count("*").alias("row_count"))


@register(
    "sql_ctas_roundtrip",
    """SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM orders GROUP BY o_orderstatus""",
)
def sql_ctas_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS into the shared folder, then a query over the written table."""
    child = open_workspace(spark, table_path(sf_dir, "orders"))
    location = scratch_path(spark, "ctas")
    name = "t_" + location.rsplit("-", 1)[1]
    child.sql(f"CREATE TABLE {name} USING parquet LOCATION '{location}' AS SELECT o_orderstatus, o_totalprice FROM orders")
    totals = child.sql(
        f"""SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
            FROM {name} GROUP BY o_orderstatus"""
    )
    child.sql(f"DROP TABLE {name}")  # leaves the files, which the plan has resolved already
    return totals
