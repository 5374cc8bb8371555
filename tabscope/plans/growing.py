"""Profiles of datasets that grow: new files are scanned, the rest comes from stored sketches.

A refresh lists the files of a dataset and scans those that no stored increment covers.
The scan makes one row per column: counts, moments, a HyperLogLog sketch of the distinct
values and a KLL sketch of the quantiles. That increment and the list of its files are
appended to a store, and the rows of all increments in use are merged. A file is known by
path, length and time of change; an increment of which a file has changed or gone is no
longer used, and its other files are scanned again. The list of files is written last, so
an increment that was not finished does not count.

Row counts, missing values, ranges, mean and standard deviation are those of a full scan
(up to the rounding of sums). Distinct counts have a relative standard error of
``DISTINCT_ERROR``, quartiles a rank error of ``RANK_ERROR`` at 99 % confidence.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.operators.classes import NUMERIC, TEMPORAL, ColumnInfo, batches, column_infos, rows_per_column
from tabscope.operators.columns import missing_pct, timestamp_text
from tabscope.session import small_frame
from tabscope.sources.files import detect_file_type, list_files, path_exists, resolve_path
from tabscope.sources.store import dataset_key

#: Sizes of the sketches and the errors that go with them.
HLL_BITS, KLL_SIZE = 14, 800
DISTINCT_ERROR, RANK_ERROR = 0.0085, 0.005
COLUMNS_PER_SCAN = 50
SKETCHES, FILES = "sketches", "files"
FILE_ID = ["path", "length", "modification_time"]


class Grown(NamedTuple):
    """``columns``: one row per column; ``rows``: their number; ``scanned``: the files read this time."""

    columns: DataFrame
    rows: int
    scanned: list[str]


def _distinct_key(info: ColumnInfo) -> Column:
    return info.key if info.key_family in ("bigint", "string") else info.key.cast("string")


def _sketched(df: DataFrame) -> DataFrame:
    """One row per column of ``df``: what can be merged later."""
    found = None
    none, blank = F.lit(None).cast("double"), F.lit(None).cast("string")
    for batch in batches(column_infos(df), COLUMNS_PER_SCAN):
        exprs, records = [F.count("*").alias("rows")], []
        for i in batch:
            o, value = i.ordinal, i.value
            exprs += [F.count_if(~i.is_missing).alias(f"n{o}"), F.hll_sketch_agg(F.when(~i.is_missing, _distinct_key(i)), HLL_BITS).alias(f"hll{o}")]
            number = value.cast("double")
            if i.kind == NUMERIC:
                exprs += [F.min(number).alias(f"min{o}"), F.max(number).alias(f"max{o}"), F.avg(number).alias(f"mean{o}")]
                exprs += [F.var_pop(number).alias(f"var{o}"), F.kll_sketch_agg_double(number, F.lit(KLL_SIZE)).alias(f"kll{o}")]
            elif i.kind == TEMPORAL:
                exprs += [F.min(value).alias(f"lo{o}"), F.max(value).alias(f"hi{o}")]
            numeric, temporal = i.kind == NUMERIC, i.kind == TEMPORAL
            records.append(
                F.struct(
                    F.lit(o).alias("ordinal"),
                    F.lit(i.name).alias("name"),
                    F.lit(i.dtype).alias("dtype"),
                    F.lit(i.kind).alias("kind"),
                    F.col("rows"),
                    F.col(f"n{o}").alias("n"),
                    F.col(f"hll{o}").alias("hll"),
                    *[(F.col(f"{s}{o}") if numeric else none).alias(s) for s in ("min", "max", "mean")],
                    (F.col(f"var{o}") * F.col(f"n{o}") if numeric else none).alias("m2"),
                    (F.when(F.col(f"n{o}") > 0, F.col(f"kll{o}")) if numeric else F.lit(None).cast("binary")).alias("kll"),
                    *[(timestamp_text(F.col(f"{e}{o}")) if temporal else blank).alias(f"date_{s}") for e, s in (("lo", "min"), ("hi", "max"))],
                )
            )
        part = rows_per_column(df.agg(*exprs), records)
        found = part if found is None else found.unionAll(part)
    return found


def _merged(sketches: DataFrame) -> DataFrame:
    """One row per column over all increments; a column that an increment lacks is missing there."""
    per_increment = sketches.select("increment", "rows").distinct().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))
    total = per_increment.first()["total"]
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))
    sums = sketches.groupBy("name").agg(
        F.max_by("ordinal", "saved_at").alias("ordinal"),
        F.max_by("dtype", "saved_at").alias("dtype"),
        F.max_by("kind", "saved_at").alias("kind"),
        F.count_distinct("dtype").alias("_types"),
        F.sum("n").alias("n"),
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("unique_count"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        mean.alias("mean"),
        F.collect_list(F.struct("n", "mean", "m2")).alias("_moments"),  # one per increment
        F.kll_merge_agg_double("kll").alias("_kll"),
        F.count("kll").alias("_kll_n"),
        F.min("date_min").alias("date_min"),
        F.max("date_max").alias("date_max"),
    )
    mixed = sums.where(F.col("_types") > 1).select("name").limit(1).collect()
    if mixed:
        raise ValueError(f"column {mixed[0]['name']} has different types in the files; profile the dataset anew")
    m2 = F.aggregate(
        "_moments", F.lit(0.0), lambda s, m: s + F.coalesce(m["m2"] + m["n"] * F.pow(m["mean"] - F.col("mean"), F.lit(2)), F.lit(0.0))
    )
    missing = F.lit(total) - F.col("n")
    quartiles = F.when(F.col("_kll_n") > 0, F.kll_sketch_get_quantile_double("_kll", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    return sums.select(
        "ordinal",
        "name",
        "dtype",
        "kind",
        missing.alias("missing_count"),
        missing_pct(missing, F.lit(total)).alias("missing_pct"),
        "unique_count",
        "min",
        "max",
        "mean",
        F.when((F.col("kind") == NUMERIC) & (F.col("n") > 1), F.sqrt(m2 / (F.col("n") - 1))).alias("std"),
        *[quartiles[k].alias(q) for k, q in enumerate(("q25", "q50", "q75"))],
        "date_min",
        "date_max",
    ), total


def _stored(spark: SparkSession, store: str, name: str, key: Column) -> DataFrame | None:
    path = f"{store.rstrip('/')}/{name}"
    if not path_exists(spark, path):
        return None
    return spark.read.parquet(path).where(F.col("dataset_key") == key)


def _in_use(files: DataFrame, current: DataFrame) -> list[str]:
    """Increments all of whose files are still as they were, and in no newer such increment."""
    found = files.join(current.select(*FILE_ID, F.lit(True).alias("_there")), FILE_ID, "left")
    whole = found.groupBy("increment").agg(F.bool_and(F.coalesce("_there", F.lit(False))).alias("whole")).where("whole")
    kept = files.join(whole.select("increment"), "increment", "left_semi")
    newest = kept.groupBy("path").agg(F.max_by("increment", "saved_at").alias("newest"))
    alone = kept.join(newest, "path").groupBy("increment").agg(F.bool_and(F.col("increment") == F.col("newest")).alias("alone"))
    return [r["increment"] for r in alone.where("alone").collect()]


def grown_profile(spark: SparkSession, path: str, store: str) -> Grown:
    """The profile of the Parquet dataset at ``path``, with new files scanned and stored in ``store``.

    CSV files are not accepted: their column types come from all files together. Types must
    not change between files; new columns may come, which earlier files are missing. An
    empty folder gives no rows.
    """
    full = resolve_path(path)
    if not path_exists(spark, full):
        raise FileNotFoundError(f"Dataset not found: {full}")
    key = dataset_key(full)
    current = list_files(spark, full)
    files = _stored(spark, store, FILES, key)
    used = _in_use(files, current) if files is not None else []
    covered = files.where(F.col("increment").isin(used)).select("path") if used else None
    fresh = current if covered is None else current.join(covered, "path", "left_anti")
    new = fresh.select(*FILE_ID).collect()  # their paths are what the reader needs
    paths = sorted(r["path"] for r in new)
    for p in paths:
        if detect_file_type(p) != "parquet":
            raise ValueError(f"not a Parquet file: {p}")
    if paths:
        increment, saved_at = uuid.uuid4().hex, datetime.now(timezone.utc).isoformat()
        marks = [F.lit(increment).alias("increment"), F.lit(saved_at).alias("saved_at"), key.alias("dataset_key")]
        base = full if all(p != resolve_path(full) and not p.endswith(full) for p in paths) else None
        reader = spark.read.option("mergeSchema", True)
        reader = reader.option("basePath", full) if base else reader
        put = lambda df, name: df.write.mode("append").partitionBy("dataset_key", "increment").parquet(f"{store.rstrip('/')}/{name}")
        put(_sketched(reader.parquet(*paths)).select("*", *marks), SKETCHES)
        listed = small_frame(spark, [tuple(r) for r in new], "path string, length bigint, modification_time timestamp")
        put(listed.select("*", *marks), FILES)
        used.append(increment)
    if not used:
        return Grown(_merged(small_frame(spark, [], STORED))[0], 0, [])
    columns, rows = _merged(_stored(spark, store, SKETCHES, key).where(F.col("increment").isin(used)))
    return Grown(columns, rows, paths)


STORED = (
    "ordinal int, name string, dtype string, kind string, rows bigint, n bigint, hll binary, min double, max double, mean double,"
    " m2 double, kll binary, date_min string, date_max string, increment string, saved_at string"
)
