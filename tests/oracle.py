"""Runs registered queries next to their oracle SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def normalised(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    shaped = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(shaped, key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs first."""
    cursor = con.execute(sql)
    want_names, want = normalised([d[0] for d in cursor.description], cursor.fetchall())
    got_names, got = normalised(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None
