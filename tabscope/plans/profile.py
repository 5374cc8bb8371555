"""The full dataset profile in three passes.

Pass A is one aggregate without a shuffle of rows (counts, missing values,
moments, ranges). Pass B counts values once per key family and reads distinct
counts, top values and - on small input - quartiles from the same shuffle. Pass C
looks for repeated rows by hash. Only statistics return to the driver, at most a
few rows per column.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.classes import NUMERIC, OTHER, TEMPORAL, ColumnInfo, batches, column_infos
from tabscope.operators.coerce import coerce_dates, detect_date_columns
from tabscope.operators.columns import (
    approx_distinct_stats,
    collect_top_values,
    missing_pct,
    moment_expressions,
    timestamp_text,
    top_from_histogram,
)
from tabscope.operators.duplicates import duplicate_count
from tabscope.operators.histogram import by_family, text_histogram, typed_histogram
from tabscope.operators.privacy import sample_rows
from tabscope.operators.quantiles import (
    approximate_quantiles,
    exact_quantiles,
)
from tabscope.operators.roles import ROLES, column_warnings, duplicate_warning, role_arrays, with_roles
from tabscope.session import scratch_path, small_frame
from tabscope.sources.files import dataset_size, detect_file_type, load_dataset, path_exists, resolve_path

TOP_K = 5
SCAN_COLUMNS = 100
SUMMARY = ["min", "max", "mean", "std"]
COLUMN_FIELDS = (
    "ordinal int, name string, dtype string, kind string, missing_count bigint, missing_pct double,"
    " unique_count bigint, min double, max double, mean double, std double, q25 double, q50 double,"
    " q75 double, date_min string, date_max string, top_values array<struct<value: string, count: bigint>>"
)


def inspect_dataset(spark: SparkSession, path: str, file_type: str | None = None) -> DataFrame:
    """``ordinal, name, dtype, row_count``; a Parquet count reads no column data."""
    return inspect_frame(load_dataset(spark, resolve_path(path), file_type))


def inspect_frame(df: DataFrame) -> DataFrame:
    records = [
        F.struct(F.lit(i.ordinal).alias("ordinal"), F.lit(i.name).alias("name"), F.lit(i.dtype).alias("dtype"))
        for i in column_infos(df)
    ]
    return df.agg(F.count("*").alias("row_count")).select(F.inline(F.array(*records)), "row_count")


def _scan_statistics(df: DataFrame, infos: list[ColumnInfo]) -> dict[str, Any]:
    """Row count, missing values, moments and ranges; wide tables in batches of columns."""
    found = {"rows": 0}
    for batch in batches(infos, SCAN_COLUMNS):
        found.update(_scan_batch(df, batch).asDict())
    return found


def _scan_batch(df: DataFrame, infos: list[ColumnInfo]) -> Row:
    exprs = [F.count("*").alias("rows")]
    for i in infos:
        exprs.append(F.count_if(i.is_missing).alias(f"missing{i.ordinal}"))
        if i.kind == NUMERIC:
            exprs += moment_expressions(i)
        elif i.kind == TEMPORAL:
            exprs += [F.min(i.value).alias(f"lo{i.ordinal}"), F.max(i.value).alias(f"hi{i.ordinal}")]
    shown = ["rows"]
    for i in infos:
        missing = F.col(f"missing{i.ordinal}")
        shown += [missing, missing_pct(missing, F.col("rows")).alias(f"pct{i.ordinal}")]
        if i.kind == NUMERIC:
            shown += [f"{s}{i.ordinal}" for s in SUMMARY]
        elif i.kind == TEMPORAL:
            shown += [timestamp_text(F.col(f"{e}{i.ordinal}")).alias(f"{e}{i.ordinal}") for e in ("lo", "hi")]
    return df.agg(*exprs).select(*shown).first()


def _typed_statistics(df: DataFrame, members: list[ColumnInfo]) -> list[Row]:
    """``ordinal, unique_count`` of the columns of one key type."""
    hist = typed_histogram(df, members)
    return hist.groupBy("ordinal").agg(F.count("*").alias("unique_count")).collect()


def text_statistics(df: DataFrame, members: list[ColumnInfo]) -> DataFrame:
    """Distinct counts (rank 0) and top values of text columns.

    Both halves use the same columns of one histogram, so that they share its exchange.
    """
    hist = text_histogram(df, members)
    counts = hist.groupBy("ordinal").agg(F.count_if(F.col("cnt") > F.col("nulls")).alias("cnt"))
    text = F.lit(None).cast("string")
    return counts.select(
        "ordinal",
        F.lit(0).alias("rank"),
        text.alias("head"),
        text.alias("digest"),
        "cnt",
        F.lit(None).cast("bigint").alias("nulls"),
    ).unionAll(top_from_histogram(hist, TOP_K))


def _value_statistics(
    df: DataFrame, infos: list[ColumnInfo], numeric: list[ColumnInfo], non_missing: dict[int, int]
) -> tuple[dict, dict, dict]:
    """Distinct counts and top values from value histograms, and quartiles of ``numeric``."""
    distinct: dict[int, int] = {}
    quartiles: dict[int, list[float]] = {}
    tops: dict[int, list[tuple[str, int]]] = {}
    families = by_family(infos)
    text = families.pop("string", [])
    # The families are independent queries over different columns.
    with ThreadPoolExecutor(max_workers=4) as pool:
        typed = [pool.submit(_typed_statistics, df, members) for members in families.values()]
        texts = pool.submit(lambda: text_statistics(df, text).collect()) if text else None
        exact = (
            pool.submit(lambda: exact_quantiles(df, infos=numeric, non_missing=non_missing).collect()) if numeric else None
        )
        for r in [r for job in typed for r in job.result()]:
            distinct[r["ordinal"]] = r["unique_count"]
        if texts:
            rows = texts.result()
            distinct.update({r["ordinal"]: r["cnt"] for r in rows if r["rank"] == 0})
            others = {i.ordinal for i in text if i.kind == OTHER}
            tops = collect_top_values(df, [r for r in rows if r["rank"] > 0 and r["ordinal"] in others])
        if exact:
            quartiles.update({r["ordinal"]: r["quantiles"] for r in exact.result()})
    return distinct, quartiles, tops


def profile_columns(df: DataFrame, approximate: bool = False) -> tuple[DataFrame, int]:
    """The statistics table (one row per column) and the row count.

    Roles and warnings alone need less, see ``light.py``. With ``approximate``, distinct counts of numeric and temporal columns and all
    quartiles are estimates, which spares the shuffle of their values.
    """
    infos = column_infos(df)
    scan = _scan_statistics(df, infos)
    rows = scan["rows"]
    exact = [i for i in infos if i.kind == OTHER] if approximate else infos
    non_missing = {i.ordinal: rows - scan[f"missing{i.ordinal}"] for i in infos}
    numeric = [i for i in infos if i.kind == NUMERIC and not approximate]
    distinct, quartiles, tops = _value_statistics(df, exact, numeric, non_missing)
    if approximate:
        estimated = [i for i in infos if i.kind != OTHER]
        counts = approx_distinct_stats(df, infos=estimated).collect() if estimated else []
        distinct.update({r["ordinal"]: r["unique_count"] for r in counts})
        quartiles = {r["ordinal"]: r["quantiles"] for r in approximate_quantiles(df).collect()}
    records = []
    for i in infos:
        numeric, temporal = i.kind == NUMERIC, i.kind == TEMPORAL
        q = quartiles.get(i.ordinal) if numeric else None
        records.append(
            (i.ordinal, i.name, i.dtype, i.kind, scan[f"missing{i.ordinal}"], scan[f"pct{i.ordinal}"])
            + (distinct.get(i.ordinal, 0),)
            + tuple(scan[f"{s}{i.ordinal}"] if numeric else None for s in SUMMARY)
            + (tuple(q) if q else (None, None, None))
            + tuple(scan[f"{e}{i.ordinal}"] if temporal else None for e in ("lo", "hi"))
            + (tops.get(i.ordinal, []) if i.kind == OTHER else None,)
        )
    return small_frame(df.sparkSession, records, COLUMN_FIELDS), rows


def profile_frame(
    df: DataFrame,
    path: str = "",
    file_type: str = "",
    size_bytes: int | None = None,
    coerce: bool = True,
    include_sample: bool = False,
    max_sample_rows: int = 5,
    redact_pii: bool = True,
    stage: bool = False,
    approximate: bool = False,
) -> DataFrame:
    """One row: table facts, the column statistics, roles, warnings and an optional sample.

    ``stage`` writes the typed rows once to the shared folder, so that the passes
    read only the columns they need instead of parsing text again. ``approximate``
    trades exact distinct counts and quartiles for fewer passes; a column is then
    seldom an identifier by uniqueness alone.
    """
    typed = coerce_dates(df, detect_date_columns(df)) if coerce else df
    rows_read = _staged(typed) if stage else typed
    # The passes do not depend on each other; threads let their small stages overlap.
    with ThreadPoolExecutor(max_workers=4) as pool:
        columns_job = pool.submit(profile_columns, rows_read, approximate=approximate)
        duplicates_job = pool.submit(lambda: duplicate_count(rows_read).first()["duplicate_count"])
        sample_job = pool.submit(_sample, typed, max_sample_rows, redact_pii) if include_sample else None
        columns, rows = columns_job.result()
        repeated = duplicates_job.result()
        sample = sample_job.result() if sample_job else None
    warnings = F.concat(
        F.flatten(
            F.transform(
                F.sort_array(F.collect_list(F.struct("ordinal", column_warnings().alias("w")))), lambda x: x["w"]
            )
        ),
        F.array_compact(F.array(duplicate_warning(F.lit(repeated)))),
    )
    per_column = F.sort_array(F.collect_list(F.struct(*columns.columns)))
    summary = with_roles(columns, rows).agg(
        *role_arrays(), per_column.alias("columns"), warnings.alias("quality_warnings")
    )
    return summary.select(
        F.lit(path).alias("path"),
        F.lit(file_type).alias("file_type"),
        F.lit(size_bytes).cast("bigint").alias("file_size_bytes"),
        F.lit(rows).cast("bigint").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        "columns",
        F.lit(repeated).cast("bigint").alias("duplicate_count"),
        *[f"{r}_columns" for r in ROLES],
        "quality_warnings",
        (F.lit(None) if sample is None else F.array(*[F.lit(s) for s in sample])).cast("array<string>").alias("sample_rows"),
        F.lit(datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")).alias("profiled_at"),
    )


def _staged(typed: DataFrame) -> DataFrame:
    spark = typed.sparkSession
    path = scratch_path(spark, "typed")
    renamed = typed.toDF(*[f"c{i}" for i in range(len(typed.columns))])
    renamed.write.parquet(path)
    return spark.read.parquet(path).toDF(*typed.columns)


def _sample(typed: DataFrame, n: int, redact: bool) -> list[str]:
    rows = sample_rows(typed, n, redact)
    return [r["j"] for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]


def profile_dataset(spark: SparkSession, path: str, file_type: str | None = None, **options) -> DataFrame:
    """Profile the dataset at ``path``. Samples are off by default and redacted when on."""
    full = resolve_path(path)
    if not path_exists(spark, full):
        raise FileNotFoundError(f"Dataset not found: {full}")
    kind = file_type or detect_file_type(full)
    size = dataset_size(spark, full).first()["file_size_bytes"]
    return profile_frame(load_dataset(spark, full, kind), path=full, file_type=kind, size_bytes=size, **options)


def compact_profile(profile: DataFrame, max_warnings: int = 5) -> DataFrame:
    """The profile without samples and statistics, with the first few warnings."""
    return profile.select(
        "path",
        "row_count",
        "column_count",
        F.transform("columns", lambda c: F.struct(c["name"], c["dtype"], c["missing_pct"])).alias("columns"),
        F.slice("quality_warnings", 1, max_warnings).alias("quality_warnings"),
        *[f"{r}_columns" for r in ROLES],
    )
