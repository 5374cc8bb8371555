"""Roles and warnings without the full profile.

One aggregate, which shuffles no rows, tells row count, missing values, date ranges and
which columns hold a single value. Warnings need no more. Most roles follow from names and
types; distinct values are counted only in the columns whose roles depend on them.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.operators.classes import BOOLEAN, NUMERIC, TEMPORAL, ColumnInfo, batches, column_infos
from tabscope.operators.columns import distinct_stats, missing_pct, timestamp_text
from tabscope.operators.histogram import HEAD_CHARS
from tabscope.operators.roles import ID_NAME, ID_TYPES, TARGET_NAME
from tabscope.session import small_frame

SCAN_COLUMNS = 100
LIGHT_FIELDS = (
    "ordinal int, name string, dtype string, kind string, missing_count bigint, missing_pct double,"
    " unique_count bigint, date_min string"
)


def needs_distinct(info: ColumnInfo) -> bool:
    """Whether a role of the column depends on its distinct count; else name and type settle all."""
    if info.kind == TEMPORAL:
        return False
    id_name = re.search(ID_NAME, info.name, re.ASCII)
    if info.dtype in ID_TYPES and not id_name:
        return True
    if info.kind in (NUMERIC, BOOLEAN):
        return not re.search(TARGET_NAME, info.name, re.ASCII)
    return not id_name


def _key(info: ColumnInfo) -> Column:
    """A value of bounded length that is equal for equal values only."""
    if info.key_family != "string":
        return info.key
    text = info.text
    long = F.length(text) > HEAD_CHARS
    return F.when(text.isNotNull(), F.struct(F.left(text, F.lit(HEAD_CHARS)).alias("head"), F.when(long, F.sha2(text, 256)).alias("digest")))


def _scan(df: DataFrame, infos: list[ColumnInfo]) -> dict[str, Any]:
    found: dict[str, Any] = {"rows": 0}
    for batch in batches(infos, SCAN_COLUMNS):
        exprs, shown = [F.count("*").alias("rows")], ["rows"]
        for i in batch:
            m, least, most = f"missing{i.ordinal}", f"least{i.ordinal}", f"most{i.ordinal}"
            exprs += [F.count_if(i.is_missing).alias(m), F.min(_key(i)).alias(least), F.max(_key(i)).alias(most)]
            single = F.when(F.col(least).isNull(), F.lit(0)).when(F.col(least) == F.col(most), F.lit(1))
            shown += [m, missing_pct(F.col(m), F.col("rows")).alias(f"pct{i.ordinal}"), single.alias(f"single{i.ordinal}")]
            if i.kind == TEMPORAL:
                exprs.append(F.min(i.value).alias(f"lo{i.ordinal}"))
                shown.append(timestamp_text(F.col(f"lo{i.ordinal}")).alias(f"lo{i.ordinal}"))
        found.update(df.agg(*exprs).select(*shown).first().asDict())
    return found


def light_statistics(df: DataFrame, distinct: bool = True) -> tuple[DataFrame, int]:
    """One row per column with what roles and warnings read, and the row count.

    ``unique_count`` is null where it is above one and no role depends on it; without
    ``distinct``, which warnings do not need, wherever it is above one.
    """
    infos = column_infos(df)
    counted = [i for i in infos if distinct and needs_distinct(i)]
    with ThreadPoolExecutor(max_workers=2) as pool:  # independent queries
        job = pool.submit(lambda: distinct_stats(df, counted).collect()) if counted else None
        scan = _scan(df, infos)
        counts = {i.ordinal: scan[f"single{i.ordinal}"] for i in infos}
        counts.update({r["ordinal"]: r["unique_count"] for r in job.result()} if job else {})
    records = [
        (i.ordinal, i.name, i.dtype, i.kind, scan[f"missing{i.ordinal}"], scan[f"pct{i.ordinal}"])
        + (counts[i.ordinal], scan.get(f"lo{i.ordinal}"))
        for i in infos
    ]
    return small_frame(df.sparkSession, records, LIGHT_FIELDS), scan["rows"]
