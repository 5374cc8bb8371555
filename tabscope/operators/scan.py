"""Running values over ordered rows of a key, also where one key holds most rows.

A window over a key sorts all its rows in one task. Here the rows of a hot key are cut
into parts of about equal size: borders are rows of a sample, ordered by time and a
number that tells equal times apart, so a burst is cut like everything else. A window
runs inside each part, a small aggregate takes the last state of each part of the hot
keys, a window over these few rows carries states on, and each row joins the carry of
its part to its own value. Keys that are not hot have one part, and no carry.

Rows move in one shuffle. What comes back to the driver is the sample of (key hash,
order, number), at most about ``SAMPLE_ROWS`` rows of four whole numbers.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegralType, TimestampNTZType, TimestampType

from tabscope.functions.names import col
from tabscope.session import scratch_path

PART_ROWS, SAMPLE_ROWS = 1_000_000, 1_000_000
#: Sampled rows for each part at least, so that parts are about equal.
LEAST_SAMPLED = 20
KINDS = ("sum", "count", "min", "max", "last")


def ordinal(value: Column, kind: DataType) -> Column:
    """A long that orders as the value does; null comes first."""
    if isinstance(kind, IntegralType):
        number = value.cast("bigint")
    elif isinstance(kind, DateType):
        number = F.unix_date(value).cast("bigint")
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        number = F.unix_micros(value.cast("timestamp"))
    else:
        raise ValueError(f"no order by {kind.simpleString()} here")
    return F.coalesce(number, F.lit(-(2**63)))


class Parts(NamedTuple):
    """Borders by hash of the key: each is a row (order, number) that begins a part."""

    borders: dict[int, list[tuple[int, int]]]

    def hot(self, hashed: Column) -> Column:
        return hashed.isin(list(self.borders)) if self.borders else F.lit(False)

    def part(self, hashed: Column, order: Column, number: Column) -> Column:
        """The part of a row: how many borders, of all keys by (hash, order, number), are at or before it.

        The borders before a key's own are the same for all its rows.
        """
        borders = sorted((key, *place) for key, places in self.borders.items() for place in places)
        if not borders:
            return F.lit(0)
        steps = 1 << len(borders).bit_length()
        hashes, orders, numbers = map(_array, zip(*borders, *[(2**63 - 1,) * 3] * (steps - 1 - len(borders))))

        def before(at: Column) -> Column:
            h, o, n = (F.element_at(a, at) for a in (hashes, orders, numbers))
            return (h < hashed) | ((h == hashed) & ((o < order) | ((o == order) & (n <= number))))

        powers = F.array(*[F.lit(1 << b) for b in reversed(range(steps.bit_length() - 1))])
        found = F.aggregate(powers, F.lit(0), lambda i, s: F.when(before(i + s), i + s).otherwise(i))
        return F.least(found, F.lit(len(borders)))


def _array(values: tuple[int, ...]) -> Column:
    """A literal array as one string of the plan, which Spark cuts and casts once, while planning.

    It does so with ``split`` and ``cast``, but not with ``transform``: that ran for each row and step.
    """
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def find_parts(rows: DataFrame, hashed: str, order: str, number: str, part_rows: int = PART_ROWS) -> Parts:
    """Borders of the keys of more than about ``part_rows`` rows, from a sample of all rows."""
    narrow = rows.select(hashed, order, number)
    n = narrow.count()
    if n <= part_rows:
        return Parts({})
    share = min(1.0, SAMPLE_ROWS / n)
    size = max(int(part_rows * share), LEAST_SAMPLED)
    sample = (narrow if share == 1.0 else narrow.sample(share, seed=1)).toArrow()
    keys, orders, numbers = (sample.column(c).to_numpy() for c in (hashed, order, number))
    by = np.lexsort((numbers, orders, keys))
    found, starts, counts = np.unique(keys[by], return_index=True, return_counts=True)
    # cut where a part is full; a part of up to twice the size stays whole
    hot = counts >= 2 * size
    borders = {}
    for key, start, count in zip(found[hot].tolist(), starts[hot], counts[hot]):
        at = by[start : start + count][size::size]
        borders[key] = list(zip(orders[at].tolist(), numbers[at].tolist()))
    return Parts(borders)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, str]],
    part_rows: int = PART_ROWS,
    number: Column | None = None,
) -> DataFrame:
    """``df`` with running values: all rows of the key up to and with the current one.

    ``values`` maps new names to (kind, column); kinds are ``sum``, ``count`` (of values
    that are not null), ``min``, ``max`` and ``last`` (the latest that is not null). The
    first column of ``order`` must be a whole number, date or timestamp; rows equal in all
    of ``order`` follow one another in any order. Nulls come first; null keys are one key.
    Sums of floating numbers depend on the order of adding, so cast to decimals where that
    matters. Columns named like the new ones, or like ``_scan_...``, are an error.

    Rows of equal first order are told apart by a whole number: that of the second column
    of ``order``, or, if there is none, one per row, so any number of them can be cut. A
    caller may give a better ``number``; it must not contradict ``order``.
    """
    clash = set(values) & set(df.columns) | {c for c in df.columns if c.startswith("_scan_")}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}")
    if unknown := {k for k, _ in values.values()} - set(KINDS):
        raise ValueError(f"no running {sorted(unknown)}")
    own_number = number is None and len(order) > 1
    if number is None:
        number = _second(df, order[1]) if own_number else F.xxhash64(F.monotonically_increasing_id())
    placed = (
        df.withColumn("_scan_hash", F.xxhash64(*map(col, keys)))
        .withColumn("_scan_order", ordinal(col(order[0]), df.schema[order[0]].dataType))
        .withColumn("_scan_number", number)
    )
    parts = find_parts(placed, "_scan_hash", "_scan_order", "_scan_number", part_rows)
    if parts.borders and not own_number:
        placed = _written(placed)  # parts and their ends must see the same numbers
    placed = placed.withColumn("_scan_part", parts.part(F.col("_scan_hash"), F.col("_scan_order"), F.col("_scan_number")))
    by = [F.col("_scan_order"), F.col("_scan_number"), *[col(c).asc_nulls_first() for c in order[1:]]]
    inside = W.partitionBy(*map(col, keys), "_scan_part").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)
    aggregates = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    for name, (kind, source) in values.items():
        value = F.last(col(source), ignorenulls=True) if kind == "last" else aggregates[kind](col(source))
        placed = placed.withColumn(name, value.over(inside))
    own = ("_scan_hash", "_scan_order", "_scan_number", "_scan_part")
    if not parts.borders:
        return placed.drop(*own)

    # the last state of each part; only the parts of hot keys, so as many rows as borders
    hot = placed.where(parts.hot(F.col("_scan_hash")))
    place = F.struct("_scan_order", "_scan_number", *[col(c) for c in order[1:]])
    states = []
    for name, (kind, source) in values.items():
        if kind == "last":
            taken = F.max_by(col(source), F.when(col(source).isNotNull(), place))
        else:
            taken = aggregates[kind](col(source))
        states.append(taken.alias(f"_scan_{name}"))
    ends = hot.groupBy(*map(col, keys), "_scan_part").agg(*states)
    before = W.partitionBy(*map(col, keys)).orderBy("_scan_part").rowsBetween(W.unboundedPreceding, -1)
    for name, (kind, _) in values.items():
        merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}.get(kind)
        state = F.col(f"_scan_{name}")
        ends = ends.withColumn(f"_scan_{name}", (F.last(state, ignorenulls=True) if merge is None else merge(state)).over(before))
    renamed = ends.select(
        *[col(k).alias(f"_scan_key{i}") for i, k in enumerate(keys)],
        F.col("_scan_part").alias("_scan_at"),
        *[f"_scan_{name}" for name in values],
    )
    same = F.col("_scan_part") == F.col("_scan_at")
    for i, k in enumerate(keys):
        same &= col(k).eqNullSafe(F.col(f"_scan_key{i}"))
    # bounded by the number of borders, so at most the size of the sample
    joined = placed.join(F.broadcast(renamed), same, "left")
    out = [col(c) for c in df.columns]
    for name, (kind, _) in values.items():
        mine, carry = col(name), F.col(f"_scan_{name}")
        if kind == "last":
            value = F.coalesce(mine, carry)
        elif kind == "min":
            value = F.least(mine, carry)
        elif kind == "max":
            value = F.greatest(mine, carry)
        else:
            value = F.coalesce(mine + carry, mine, carry)
        out.append(value.cast(placed.schema[name].dataType).alias(name))
    return joined.select(*out)


def _second(df: DataFrame, name: str) -> Column:
    """The number of the second order column; 0 for all rows where it has none, so they stay together."""
    try:
        return ordinal(col(name), df.schema[name].dataType)
    except ValueError:
        return F.lit(0).cast("bigint")


def _written(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, "scan")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
