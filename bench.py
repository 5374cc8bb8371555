"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores. Every
query is executed in full (all rows and columns of its result, written to a no-op
sink), once for warm-up and then ``BENCH_RUNS`` times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tabscope import local_session
from tabscope.plans.coverage import QUERIES

HEADLINE = [
    "monthly_trend_lineitem",
    "monthly_trend_orders",
    "metric_by_dimension",
    "mom_change",
    "profile_missing",
    "profile_distinct",
    "profile_numeric",
    "profile_duplicates",
    "profile_top_values",
    "profile_full",
    "roles",
    "redact_documents",
    "redact_pages",
    "pii_counts",
    "sql_agg_basic",
    "sql_join_star",
    "sql_count_distinct",
    "sql_win_rank",
    "sql_qualify",
    "sql_asof",
    "sql_win_running",
    "sql_join_interval",
    "sql_sample_rows",
    "sql_topk",
    "sql_row_count",
    "scan_csv",
    "notebook_cells",
    "catalog_summary",
    "log_last_sql",
    "dataset_trend",
    "profile_quantiles_approx",
    "sql_join_range",
    "scan_csv_sql",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = os.environ.get("BENCH_ONLY")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in only.split(",") if only else HEADLINE:
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
