"""Joins over intervals: points inside intervals, and intervals that overlap.

Spark plans such conditions as a nested loop, or, behind an equality, as all pairs of
equal keys. Here both sides meet in cells instead. Quantiles of the points cut the line
into bins of about equal rows; inside a bin, cells halve its width three times per level.
An interval goes to the cells it touches at one level, the finest at which these are few;
a point goes to its one cell at every level in use. So each pair meets in exactly one
cell, where the condition itself is tested, and the pairs tested stay in proportion to
the pairs found: a short interval meets few points too many, and of the bins that a long
one spans all points but those at its ends are results.

Bins that hold more rows than meant (many equal points, or many intervals that start
together) are split: each row of the large side takes one share, and the other side goes
to all of them. With ``keys`` the rows must also be equal in them; then levels coarser
than a bin keep long intervals of small keys from spreading over all bins, and Spark's
skew join splits the partitions of hot keys. Neither side is ever broadcast.

Where only counts and sums over the pairs are asked for, ``interval_totals`` makes no pairs:
their number grows with the product of the sides.

Only quantiles and counts per bin come back to the driver (at most ``MOST_BINS`` each).
"""

from __future__ import annotations

import math
import os
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, IntegralType, NumericType, TimestampNTZType, TimestampType

from tabscope.functions.names import col
from tabscope.session import scratch_path

ROWS_PER_BIN, MOST_BINS = 65_536, 4_096
#: Cells of a level for each cell of the level before, and cells that an interval may touch besides the first.
STEP_BITS, MOST_CELLS = 3, 8
OWN = ("_bin", "_part", "_level", "_cell", "_share", "_copy", "_low", "_high", "_low_part", "_high_part", "_row", "_at", "_id")


def _number(value: Column, kind: DataType) -> Column:
    """A double that rises with the value; it chooses cells, the test uses the value itself."""
    if isinstance(kind, NumericType):
        number = value.cast("double")
        return F.when(F.isnan(number), F.lit(float("inf"))).otherwise(number)  # NaN sorts last
    if isinstance(kind, DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    raise ValueError(f"no interval join over values of type {kind.simpleString()}")


def _array(values: list) -> Column:
    """A literal array; as one string it stays one node of the plan."""
    kind = "bigint" if all(isinstance(v, int) for v in values) else "double"
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


class Line(NamedTuple):
    """Bins of the line: borders between them, and the least and greatest point."""

    borders: list[float]
    least: float
    most: float

    def bin(self, x: Column) -> Column:
        """How many borders are at or below x, by binary search."""
        if not self.borders:
            return F.lit(0).cast("bigint")
        steps = 1 << (len(self.borders)).bit_length()
        padded = _array(self.borders + [float("inf")] * (steps - 1 - len(self.borders)))
        powers = F.array(*[F.lit(1 << b).cast("bigint") for b in reversed(range(steps.bit_length() - 1))])
        found = F.aggregate(
            powers,
            F.lit(0).cast("bigint"),
            lambda i, s: F.when(F.element_at(padded, (i + s).cast("int")) <= x, i + s).otherwise(i),
        )
        return F.least(found, F.lit(len(self.borders)).cast("bigint"))

    def part(self, x: Column, at: Column) -> Column:
        """Where x lies inside its bin, from 0 to less than 1."""
        edges = _array([self.least, *self.borders, self.most])
        low, high = F.element_at(edges, (at + 1).cast("int")), F.element_at(edges, (at + 2).cast("int"))
        inside = F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
        return F.when(inside >= 1, 1 - 2.0**-40).when(inside > 0, inside).otherwise(0.0)


def _cell(at: Column, part: Column, level: int) -> Column:
    if level <= 0:
        return F.shiftright(at, -level * STEP_BITS)
    width = 1 << level * STEP_BITS
    return at * width + F.floor(part * width)


def _shares(counted: dict, bins: int, most: int) -> list[int]:
    return [max(1, math.ceil(counted.get(b, 0) / most)) for b in range(bins)]


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    value: str,
    low: str,
    high: str,
    keys: tuple[str, ...] | list[str] = (),
    closed: str = "left",
    unbounded: bool = False,
    how: str = "inner",
    rows_per_bin: int = ROWS_PER_BIN,
) -> DataFrame:
    """Pairs of a point and an interval that holds it: all columns of both, ``keys`` once.

    ``closed`` says which ends belong to an interval: ``left``, ``right``, ``both`` or
    ``neither``. A null end matches nothing, or, if ``unbounded``, has no limit on that
    side. Null points and keys match nothing; intervals whose ends are in the wrong order
    hold nothing; NaN lies above all numbers. Repeated rows are rows of their own. ``how``
    is ``inner`` or ``left``, which keeps points without an interval. Both sides must have
    other column names but for the keys; ends and points must be numbers, dates or
    timestamps of one kind.
    """
    keys = list(keys)
    clash = ((set(points.columns) & set(intervals.columns)) - set(keys)) | ((set(points.columns) | set(intervals.columns)) & set(OWN))
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)} of one side")
    if how not in ("inner", "left") or closed not in ("left", "right", "both", "neither"):
        raise ValueError(f"unknown kind of join: {how}, {closed}")
    kinds = _kinds(points, intervals, value, low, high)
    if how == "left":
        points = _numbered(points)

    known = [col(k).isNotNull() for k in keys]
    usable = points.where(col(value).isNotNull())
    ends = col(low).isNotNull() & col(high).isNotNull()
    order = F.coalesce(col(low) <= col(high), F.lit(unbounded))
    held = intervals.where(order if unbounded else ends & order)
    for k in known:
        usable, held = usable.where(k), held.where(k)

    least, most = (F.lit(float(x)) for x in ("-inf", "inf"))
    x = _number(col(value), kinds[0])
    ends_at = F.coalesce(_number(col(low), kinds[1]), least), F.coalesce(_number(col(high), kinds[2]), most)
    line = _line(usable, x, rows_per_bin)
    bins = len(line.borders) + 1
    finest = max(0, int(math.log(max(rows_per_bin / 4, 1), 1 << STEP_BITS)))
    coarsest = -math.ceil((bins - 1).bit_length() / STEP_BITS) if keys else 0
    levels = list(range(finest, coarsest - 1, -1))

    placed = usable.withColumn("_bin", line.bin(x)).withColumn("_part", line.part(x, F.col("_bin")))
    # plain columns: Spark computes a column that is used several times once, but not the fields of a struct
    laid = held.withColumn("_low", line.bin(ends_at[0])).withColumn("_high", line.bin(ends_at[1]))
    laid = laid.withColumn("_low_part", line.part(ends_at[0], F.col("_low"))).withColumn("_high_part", line.part(ends_at[1], F.col("_high")))

    def touched(level: int) -> tuple[Column, Column]:
        return _cell(F.col("_low"), F.col("_low_part"), level), _cell(F.col("_high"), F.col("_high_part"), level)

    chosen = F.lit(levels[-1])
    for level in reversed(levels[:-1]):
        first, last = touched(level)
        chosen = F.when(last - first <= MOST_CELLS, level).otherwise(chosen)
    laid = laid.withColumn("_level", chosen)

    most_rows = 4 * rows_per_bin
    shares = _shares({r["_bin"]: r["n"] for r in placed.groupBy("_bin").agg(F.count("*").alias("n")).collect()}, bins, most_rows)
    starts = laid.groupBy(F.col("_low").alias("_bin"), "_level").agg(F.count("*").alias("n")).collect()
    used = sorted({r["_level"] for r in starts}) or [finest]
    by_bin: dict[int, int] = {}
    for r in starts:
        by_bin[r["_bin"]] = by_bin.get(r["_bin"], 0) + r["n"]
    copies = _shares(by_bin, bins, most_rows)
    # a cell coarser than a bin has one share for all its bins
    fine = levels[-1] >= 0
    share, copy = (
        (lambda at, n=n: F.element_at(_array(n), (at + 1).cast("int"))) if fine and max(n) > 1 else (lambda at: F.lit(1).cast("bigint"))
        for n in (shares, copies)
    )

    cells = F.array(*[F.struct(F.lit(v).alias("_level"), _cell(F.col("_bin"), F.col("_part"), v).alias("_cell")) for v in used])
    # a row's number is drawn before the row is sent to several cells, so its share is one
    numbered = placed.withColumn("_row", F.xxhash64(F.monotonically_increasing_id()))
    sent = numbered.withColumn("_at", F.explode(cells)).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copy(F.col("_bin")))))
    dealt = F.pmod("_row", share(F.col("_bin"))) + 1
    left = sent.select(*points.columns, "_at._level", "_at._cell", dealt.alias("_share"), "_copy")

    spread = F.lit(None).cast("array<bigint>")
    for level in used:
        spread = F.when(F.col("_level") == level, F.sequence(*touched(level))).otherwise(spread)
    sent = laid.withColumn("_row", F.xxhash64(F.monotonically_increasing_id())).withColumn("_cell", F.explode(spread))
    bin_of = F.lit(0).cast("bigint")
    for level in used:
        if level >= 0:
            bin_of = F.when(F.col("_level") == level, F.shiftright("_cell", level * STEP_BITS)).otherwise(bin_of)
    sent = sent.withColumn("_bin", bin_of).withColumn("_share", F.explode(F.sequence(F.lit(1).cast("bigint"), share(F.col("_bin")))))
    dealt = F.pmod("_row", copy(F.col("_bin"))) + 1
    right = sent.select(*[c for c in intervals.columns], "_level", "_cell", "_share", dealt.alias("_copy"))

    above = col(value) >= col(low) if closed in ("left", "both") else col(value) > col(low)
    below = col(value) <= col(high) if closed in ("right", "both") else col(value) < col(high)
    if unbounded:
        above, below = above | col(low).isNull(), below | col(high).isNull()
    # Spark's estimates do not know how often explode repeats a row: by them it would broadcast a side of any size
    met = left.join(right.hint("merge"), [*keys, "_level", "_cell", "_share", "_copy"]).where(above & below)
    names = [c for c in points.columns if c != "_id"] + [c for c in intervals.columns if c not in keys]
    if how == "inner":
        return met.select(*map(col, names))
    alone = points.join(met.select("_id").distinct(), "_id", "left_anti")
    nothing = [F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in intervals.columns if c not in keys]
    own = [col(c) for c in points.columns if c != "_id"]
    return met.select(*map(col, names)).unionByName(alone.select(*own, *nothing))


def _kinds(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str) -> list[DataType]:
    kinds = [points.schema[value].dataType, intervals.schema[low].dataType, intervals.schema[high].dataType]
    if len({"number" if isinstance(k, NumericType) else k.simpleString() for k in kinds}) > 1:
        raise ValueError(f"points and ends are of different types: {[k.simpleString() for k in kinds]}")
    return kinds


def _numbered(points: DataFrame) -> DataFrame:
    """``points`` with a number per row, written so that every use sees the same numbers."""
    spark = points.sparkSession
    path = os.path.join(scratch_path(spark, "points"))
    points.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def _line(points: DataFrame, x: Column, rows_per_bin: int) -> Line:
    finite = F.when(F.abs(x) < float("inf"), x)
    n, least, most = points.agg(F.count("*"), F.min(finite), F.max(finite)).first()
    if least is None:
        return Line([], 0.0, 0.0)
    bins = min(MOST_BINS, math.ceil(n / rows_per_bin))
    if bins < 2:
        return Line([], least, most)
    places = [i / bins for i in range(1, bins)]
    found = points.agg(F.percentile_approx(finite, places, 20 * bins)).first()[0]
    return Line(sorted(set(found) - {least}), least, most)


def interval_totals(
    points: DataFrame,
    intervals: DataFrame,
    value: str,
    low: str,
    high: str,
    by: list[str],
    count: str,
    sums: dict[str, str],
    closed: str = "left",
    rows_per_bin: int = ROWS_PER_BIN,
) -> DataFrame:
    """Totals of ``interval_join`` for each ``by`` of the intervals, without its pairs.

    Columns are ``by``, ``count`` (the number of pairs) and ``sums``, which maps new names to
    columns of the points: whole numbers or decimals, since floating sums would not be exact.
    Sums are decimals; nulls do not count, and the sum of nothing but nulls is null. Groups
    without a pair are left out. Null and wrong ends, types and ``closed`` are as there.

    What an interval holds is what the points before its end have more than those before
    its start. Points of one value are one row. Ends lie among them in quantile bins, where
    a window adds up; the totals of the bins before are added. In bins with many ends, each
    end takes one share, and the points go to all of them. So the work grows with the rows.
    """
    if closed not in ("left", "right", "both", "neither"):
        raise ValueError(f"unknown kind of join: {closed}")
    if len({*by, count, *sums}) < len(by) + 1 + len(sums):
        raise ValueError("totals need names of their own")
    if wrong := [c for c in sums.values() if not isinstance(points.schema[c].dataType, (IntegralType, DecimalType))]:
        raise ValueError(f"no exact sums of {wrong}")
    kinds = _kinds(points, intervals, value, low, high)

    # what is added up: pairs, and for each sum its values and those that are not null
    scales = [getattr(points.schema[c].dataType, "scale", 0) for c in sums.values()]
    parts = [F.count("*").cast("decimal(38,0)").alias("_t0")]
    for i, (source, scale) in enumerate(zip(sums.values(), scales)):
        parts += [F.count(col(source)).cast("decimal(38,0)").alias(f"_t{2 * i + 1}")]
        parts += [F.coalesce(F.sum(col(source).cast(f"decimal(38,{scale})")), F.lit(0).cast(f"decimal(38,{scale})")).alias(f"_t{2 * i + 2}")]
    names = [f"_t{i}" for i in range(len(parts))]
    spark = points.sparkSession
    path = scratch_path(spark, "totals")
    points.where(col(value).isNotNull()).groupBy(col(value).alias("_value")).agg(*parts).write.parquet(path)
    at = spark.read.parquet(path)

    # points have place 1 at their value: an end at 0 comes before those of equal value, one at 2 after them
    held = intervals.where(col(low) <= col(high) if closed == "both" else col(low) < col(high))
    keys = [col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    first, last = (0 if closed in ("left", "both") else 2), (2 if closed in ("right", "both") else 0)
    line = _line(at, _number(F.col("_value"), kinds[0]), rows_per_bin)
    bins = len(line.borders) + 1
    both_ends = [
        F.struct(col(end).alias("_value"), F.lit(place).alias("_place"), F.lit(sign).alias("_sign"))
        for end, place, sign in ((low, first, -1), (high, last, 1))
    ]
    ends = held.select(*keys, F.inline(F.array(*both_ends)))

    def binned(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bin", line.bin(_number(F.col("_value"), rows.schema["_value"].dataType)))

    counted = {r["_bin"]: r["n"] for r in binned(ends).groupBy("_bin").agg(F.count("*").alias("n")).collect()}
    share = F.element_at(_array(_shares(counted, bins, 4 * rows_per_bin)), (F.col("_bin") + 1).cast("int"))
    # the number comes before the bin: Spark 4.1 fails where it moves the search for a bin below a union
    both = at.withColumn("_place", F.lit(1)).unionByName(ends, allowMissingColumns=True)
    both = binned(both.withColumn("_row", F.xxhash64(F.monotonically_increasing_id())))
    all_or_one = F.when(F.col("_sign").isNull(), F.sequence(F.lit(1).cast("bigint"), share)).otherwise(F.array(F.pmod("_row", share) + 1))
    both = both.withColumn("_share", F.explode(all_or_one))
    inside = W.partitionBy("_bin", "_share").orderBy("_value", "_place").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = both.select("_bin", "_sign", *[f"_by{i}" for i in range(len(by))], *[F.sum(t).over(inside).alias(t) for t in names])

    # one row a bin, so the window over all of them and the broadcast are small
    totals = spark.range(bins).select(F.col("id").alias("_bin")).join(binned(at).groupBy("_bin").agg(*[F.sum(t).alias(t) for t in names]), "_bin", "left")
    earlier = W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("_bin", *[F.sum(t).over(earlier).alias(f"{t}_before") for t in names])
    found = summed.where(F.col("_sign").isNotNull()).join(F.broadcast(carried), "_bin", "left")

    nothing = [F.lit(0).cast(at.schema[t].dataType) for t in names]
    before = [F.coalesce(F.col(t), z) + F.coalesce(F.col(f"{t}_before"), z) for t, z in zip(names, nothing)]
    groups = found.groupBy(*[f"_by{i}" for i in range(len(by))]).agg(
        *[F.sum(F.when(F.col("_sign") > 0, b).otherwise(-b).cast(at.schema[t].dataType)).alias(t) for t, b in zip(names, before)]
    )
    return groups.where(F.col("_t0") > 0).select(
        *[F.col(f"_by{i}").alias(c) for i, c in enumerate(by)],
        F.col("_t0").cast("bigint").alias(count),
        *[F.when(F.col(f"_t{2 * i + 1}") > 0, F.col(f"_t{2 * i + 2}")).alias(name) for i, name in enumerate(sums)],
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_ends: tuple[str, str],
    right_ends: tuple[str, str],
    keys: tuple[str, ...] | list[str] = (),
    closed: bool = True,
    rows_per_bin: int = ROWS_PER_BIN,
) -> DataFrame:
    """Pairs of intervals that overlap: all columns of both sides, ``keys`` once.

    Two intervals overlap if the right one starts inside the left one, or the left one
    starts inside the right one but after its start: two joins of points and intervals
    that share no pair. ``closed`` intervals overlap where a <= d and c <= b, others where
    a < d and c < b. Null ends and ends in the wrong order match nothing.
    """
    (a, b), (c, d) = left_ends, right_ends
    left = left.where(col(a) <= col(b))
    right = right.where(col(c) <= col(d))
    first = interval_join(right, left, c, a, b, keys, "both" if closed else "left", rows_per_bin=rows_per_bin)
    if not closed:
        first = first.where(col(a) < col(d))
    second = interval_join(left, right, a, c, d, keys, "right" if closed else "neither", rows_per_bin=rows_per_bin)
    return second.unionByName(first)
