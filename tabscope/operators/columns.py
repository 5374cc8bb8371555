"""Per-column statistics: missing values, distinct values, summaries, top values."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabscope.operators.classes import (
    NUMERIC,
    OTHER,
    TEMPORAL,
    ColumnInfo,
    column_infos,
    rows_per_column,
)
from tabscope.operators.histogram import HEAD_CHARS, by_family, text_histogram, typed_histogram
from tabscope.operators.quantiles import QUARTILES, exact_quantiles
from tabscope.session import small_frame


def missing_pct(missing: Column, total: Column) -> Column:
    """Percentage to two digits; 0 for an empty table."""
    return F.when(total > 0, F.bround(missing * F.lit(100.0) / total, 2)).otherwise(F.lit(0.0))


def timestamp_text(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with microseconds only where there are any."""
    ts = value.cast("timestamp_ntz")
    return F.when(
        F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _identity(info: ColumnInfo) -> list[Column]:
    return [F.lit(info.ordinal).alias("ordinal"), F.lit(info.name).alias("name")]


def missing_stats(df: DataFrame) -> DataFrame:
    """One row per column: ``ordinal, name, dtype, missing_count, missing_pct``; one scan."""
    infos = column_infos(df)
    agg = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(i.is_missing).alias(f"m{i.ordinal}") for i in infos],
    )
    return rows_per_column(
        agg,
        [
            F.struct(
                *_identity(i),
                F.lit(i.dtype).alias("dtype"),
                F.col(f"m{i.ordinal}").alias("missing_count"),
                missing_pct(F.col(f"m{i.ordinal}"), F.col("rows")).alias("missing_pct"),
            )
            for i in infos
        ],
    )


def distinct_stats(df: DataFrame, infos: list[ColumnInfo] | None = None) -> DataFrame:
    """One row per column: ``ordinal, name, unique_count`` (exact, missing values excluded)."""
    infos = infos or column_infos(df)
    parts = []
    for family, members in by_family(infos).items():
        if family == "string":
            parts.append(
                text_histogram(df, members)
                .groupBy("ordinal")
                .agg(F.count_if(F.col("cnt") > F.col("nulls")).alias("unique_count"))
            )
        else:
            parts.append(
                typed_histogram(df, members).groupBy("ordinal").agg(F.count("*").alias("unique_count"))
            )
    return _complete(df, reduce(DataFrame.unionAll, parts), infos, "unique_count")


def _complete(df: DataFrame, found: DataFrame, infos: list[ColumnInfo], count_name: str) -> DataFrame:
    """Name the columns and add zero rows for columns without any value."""
    names = small_frame(df.sparkSession, [(i.ordinal, i.name) for i in infos], "ordinal int, name string")
    return names.join(found, "ordinal", "left").select(
        "ordinal", "name", F.coalesce(count_name, F.lit(0)).alias(count_name)
    )


def approx_distinct_stats(df: DataFrame, rsd: float = 0.02, infos: list[ColumnInfo] | None = None) -> DataFrame:
    """Opt-in variant of ``distinct_stats``: one scan, no shuffle of values."""
    infos = infos or column_infos(df)
    agg = df.agg(*[F.approx_count_distinct(i.key, rsd).alias(f"u{i.ordinal}") for i in infos])
    return rows_per_column(
        agg, [F.struct(*_identity(i), F.col(f"u{i.ordinal}").alias("unique_count")) for i in infos]
    )


def moment_expressions(info: ColumnInfo) -> list[Column]:
    value = info.value.cast("double")
    return [
        F.min(info.value).cast("double").alias(f"min{info.ordinal}"),
        F.max(info.value).cast("double").alias(f"max{info.ordinal}"),
        F.avg(value).alias(f"mean{info.ordinal}"),
        F.stddev_samp(value).alias(f"std{info.ordinal}"),
    ]


def numeric_stats(df: DataFrame, **quantile_options) -> DataFrame:
    """One row per numeric column: ``min, max, mean, std, q25, q50, q75`` as doubles."""
    infos = [i for i in column_infos(df) if i.kind == NUMERIC]
    quantiles = exact_quantiles(df, QUARTILES, infos=infos, **quantile_options)
    if not infos:
        return quantiles.selectExpr(
            "ordinal", "'' as name", *[f"cast(null as double) as {c}" for c in ("min", "max", "mean", "std", "q25", "q50", "q75")]
        )
    agg = df.agg(*[e for i in infos for e in moment_expressions(i)])
    moments = rows_per_column(
        agg,
        [
            F.struct(*_identity(i), *[F.col(f"{s}{i.ordinal}").alias(s) for s in ("min", "max", "mean", "std")])
            for i in infos
        ],
    )
    return moments.join(quantiles, "ordinal", "left").select(
        *moments.columns, *[F.col("quantiles")[k].alias(q) for k, q in enumerate(("q25", "q50", "q75"))]
    )


def date_ranges(df: DataFrame) -> DataFrame:
    """One row per temporal column with any value: ``ordinal, name, date_min, date_max``."""
    infos = [i for i in column_infos(df) if i.kind == TEMPORAL]
    if not infos:
        return small_frame(df.sparkSession, [], "ordinal int, name string, date_min string, date_max string")
    agg = df.agg(
        *[F.min(i.value).alias(f"lo{i.ordinal}") for i in infos],
        *[F.max(i.value).alias(f"hi{i.ordinal}") for i in infos],
    )
    return rows_per_column(
        agg,
        [
            F.struct(
                *_identity(i),
                timestamp_text(F.col(f"lo{i.ordinal}")).alias("date_min"),
                timestamp_text(F.col(f"hi{i.ordinal}")).alias("date_max"),
            )
            for i in infos
        ],
    ).where(F.col("date_min").isNotNull())


def top_from_histogram(hist: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent keys per column.

    Ties go by the first 64 characters, then by digest; ``collect_top_values`` puts values
    of one head in order. The literal ``rank <= k`` lets Spark keep only k rows per column
    in each task before the shuffle.
    """
    order = W.partitionBy("ordinal").orderBy(F.desc("cnt"), F.asc("head"), F.asc_nulls_first("digest"))
    return (
        hist.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("ordinal", "rank", "head", "digest", "cnt", "nulls")
    )


def full_texts(df: DataFrame, wanted: dict[int, list[str]]) -> dict[tuple[int, str], str]:
    """The texts behind a few digests per column; one scan, one row back per digest."""
    infos = {i.ordinal: i for i in column_infos(df)}
    pairs = ", ".join(f"{o}, v{o}" for o in wanted)
    rows = (
        df.select([infos[o].text.alias(f"v{o}") for o in wanted])
        .selectExpr(f"stack({len(wanted)}, {pairs}) as (ordinal, value)")
        .where(F.length("value") > HEAD_CHARS)
        .withColumn("digest", F.sha2("value", 256))
        .where(reduce(lambda a, b: a | b, [(F.col("ordinal") == o) & F.col("digest").isin(d) for o, d in wanted.items()]))
        .groupBy("ordinal", "digest")
        .agg(F.any_value("value").alias("value"))
        .collect()
    )
    return {(r["ordinal"], r["digest"]): r["value"] for r in rows}


def least_of_ties(df: DataFrame, info: ColumnInfo, head: str, cnt: int, k: int) -> list[str]:
    """Digests of the ``k`` least values among those that start with ``head`` and come ``cnt`` times.

    Values are told apart by what follows their common prefix, ``HEAD_CHARS`` characters at
    a time, and only the groups that still hold several of them go into the next round. A
    round shuffles a digest and those characters for each value; prefixes come back as
    digests, so no text reaches the driver.
    """
    digest = lambda v: F.sha2(v, 256)
    start = df.select(info.text.alias("v")).where(F.left("v", F.lit(HEAD_CHARS)) == head)

    def settle(rows: DataFrame, least: int) -> list[str]:
        ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("b"))
        letters = F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: x.eqNullSafe(y))
        differ = F.array_position(letters, False) - 1
        shared, only = ends.select(F.when(F.col("a") != F.col("b"), differ), digest(F.col("a"))).first()
        if shared is None:
            return [only]
        reach = int(shared) + HEAD_CHARS
        piece = F.substring(F.col("v"), int(shared) + 1, HEAD_CHARS).alias("piece")
        values = rows.groupBy(digest(F.col("v")).alias("digest"), piece, digest(F.left("v", F.lit(reach))).alias("prefix"))
        tied = values.agg(F.count("*").alias("cnt")).where(F.col("cnt") == cnt)
        groups = tied.groupBy("piece", "prefix").agg(F.count("*").alias("n"), F.min("digest").alias("digest"))
        found: list[str] = []
        for g in groups.orderBy("piece").limit(least).collect():
            left = least - len(found)
            if not left:
                break
            more = [g["digest"]]
            if g["n"] > 1:
                more = settle(rows.where(digest(F.left("v", F.lit(reach))) == g["prefix"]), min(left, g["n"]))
            found += more
        return found

    return settle(start, k)


def collect_top_values(df: DataFrame, tops: list) -> dict[int, list[tuple[str, int]]]:
    """``ordinal -> [(value, count)]`` from the at most k rows per column of a top list.

    Values go by count, then by value. Among those of one count and one head the list
    holds some; which ones belong, and their order, is found in the data.
    """
    infos = {i.ordinal: i for i in column_infos(df)}
    columns: dict[int, list] = {}
    for row in sorted(tops, key=lambda r: (r["ordinal"], r["rank"])):
        columns.setdefault(row["ordinal"], []).append(row)
    chosen: dict[int, list[tuple[str, str | None, int]]] = {}
    for ordinal, rows in columns.items():
        places = chosen.setdefault(ordinal, [])
        for (cnt, head), group in groupby(rows, key=lambda r: (r["cnt"], r["head"])):
            members = list(group)
            digests = [r["digest"] for r in members]
            if len(head) == HEAD_CHARS and (len(members) > 1 or members[-1] is rows[-1]):
                own = hashlib.sha256(head.encode()).hexdigest()
                settled = least_of_ties(df, infos[ordinal], head, cnt, len(members))
                digests = [None if d == own else d for d in settled]
            places += [(head, d, cnt) for d in digests]
    wanted = {o: [d for _, d, _ in places if d is not None] for o, places in chosen.items()}
    wanted = {o: digests for o, digests in wanted.items() if digests}
    texts = full_texts(df, wanted) if wanted else {}
    return {o: [(head if d is None else texts[o, d], cnt) for head, d, cnt in places] for o, places in chosen.items()}


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """Rows ``ordinal, name, rank, value, count`` of the most frequent values.

    Covers the columns that are neither numeric nor temporal. Missing values are
    one bucket, shown as ``None``.
    """
    spark = df.sparkSession
    schema = "ordinal int, name string, rank int, value string, count bigint"
    infos = {i.ordinal: i for i in column_infos(df) if i.kind == OTHER}
    if not infos:
        return small_frame(spark, [], schema)
    tops = top_from_histogram(text_histogram(df, list(infos.values())), k).collect()
    found = collect_top_values(df, tops)
    return small_frame(
        spark, [(o, infos[o].name, n + 1, v, c) for o, pairs in found.items() for n, (v, c) in enumerate(pairs)], schema
    )
