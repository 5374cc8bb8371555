"""Exact quartiles without gathering a column in one task.

Ranks are found by repeated narrowing, as in a distributed
quickselect. Pivots around each wanted rank come from about ``PIVOT_ROWS`` random
rows; exact counts of *all* rows against the pivots then say between which two the
rank lies, and the next round looks only there. The random rows merely steer the
search, and a bad pivot costs another round: the answer comes from the exact
counts. A round is two scans that shuffle about a million values in total, however
large the input, and leaves under one percent of the values.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabscope.operators.classes import NUMERIC, ColumnInfo, batches, column_infos
from tabscope.session import small_frame

QUARTILES = (0.25, 0.5, 0.75)
LEAF_ROWS = 1_000_000
PIVOT_ROWS = 1_000_000
ACCURACY = 10_000
SEED = 17
COLUMNS_PER_BATCH = 16
RESULT_SCHEMA = "ordinal int, quantiles array<double>"


@dataclass
class Interval:
    """Values strictly between ``low`` and ``high`` (None = unbounded) of one column."""

    info: ColumnInfo
    low: float | None
    high: float | None
    below: int
    inside: int
    ranks: list[int] = field(default_factory=list)

    def contains(self) -> Column:
        value = self.info.value.cast("double")
        test = value.isNotNull()
        if self.low is not None:
            test = test & (value > F.lit(self.low))
        if self.high is not None:
            test = test & (value < F.lit(self.high))
        return test

    def member(self) -> Column:
        return F.when(self.contains(), self.info.value.cast("double"))


def exact_quantiles(
    df: DataFrame,
    probabilities: tuple[float, ...] = QUARTILES,
    leaf_rows: int = LEAF_ROWS,
    pivot_rows: int = PIVOT_ROWS,
    infos: list[ColumnInfo] | None = None,
    non_missing: dict[int, int] | None = None,
) -> DataFrame:
    """``ordinal, quantiles`` of the numeric columns, linearly interpolated."""
    infos = [i for i in (infos or column_infos(df)) if i.kind == NUMERIC]
    if not infos:
        return small_frame(df.sparkSession, [], RESULT_SCHEMA)
    counts = non_missing or _non_missing(df, infos)
    found = {}
    for batch in batches(infos, COLUMNS_PER_BATCH):
        found.update(_select(df, batch, counts, probabilities, leaf_rows, pivot_rows))
    return small_frame(
        df.sparkSession,
        [(i.ordinal, _interpolated(found[i.ordinal], counts[i.ordinal], probabilities)) for i in infos],
        RESULT_SCHEMA,
    )


def _non_missing(df: DataFrame, infos: list[ColumnInfo]) -> dict[int, int]:
    row = df.agg(*[F.count(i.value).alias(f"n{i.ordinal}") for i in infos]).first()
    return {i.ordinal: row[f"n{i.ordinal}"] for i in infos}


def _wanted_ranks(n: int, probabilities: tuple[float, ...]) -> list[int]:
    ranks = set()
    for p in probabilities:
        position = p * (n - 1)
        ranks |= {math.floor(position), math.ceil(position)}
    return sorted(ranks)


def _interpolated(values: dict[int, float], n: int, probabilities: tuple[float, ...]) -> list[float] | None:
    if n == 0:
        return None
    result = []
    for p in probabilities:
        position = p * (n - 1)
        low, high = math.floor(position), math.ceil(position)
        if values[low] == values[high]:
            result.append(values[low])
        else:
            result.append((high - position) * values[low] + (position - low) * values[high])
    return result


def _select(
    df: DataFrame,
    infos: list[ColumnInfo],
    counts: dict[int, int],
    probabilities: tuple[float, ...],
    leaf_rows: int,
    pivot_rows: int,
) -> dict[int, dict[int, float]]:
    found: dict[int, dict[int, float]] = {i.ordinal: {} for i in infos}
    open_intervals = [
        Interval(i, None, None, 0, counts[i.ordinal], _wanted_ranks(counts[i.ordinal], probabilities))
        for i in infos
        if counts[i.ordinal]
    ]
    leaves: list[Interval] = []
    for turn in itertools.count():
        leaves += [x for x in open_intervals if x.inside <= leaf_rows]
        open_intervals = [x for x in open_intervals if x.inside > leaf_rows]
        if not open_intervals:
            break
        cuts = _propose_cuts(df, open_intervals, pivot_rows, SEED + turn)
        if any(cuts):
            open_intervals = _narrow(df, open_intervals, cuts, found)
    if leaves:
        _read_leaves(df, leaves, found)
    return found


def _propose_cuts(df: DataFrame, intervals: list[Interval], pivot_rows: int, seed: int) -> list[list[float]]:
    """Pivots that enclose the ranks of each interval; none if no random row fell into it."""
    members, sketches = [], []
    for k, interval in enumerate(intervals):
        taken = min(pivot_rows, interval.inside)
        # Four standard errors of a rank among the random rows, plus the sketch error.
        margin = (2.0 / math.sqrt(taken) if taken < interval.inside else 0.0) + 2.0 / ACCURACY
        points = set()
        for rank in interval.ranks:
            at = (rank - interval.below + 0.5) / interval.inside
            points |= {max(0.0, at - margin), min(1.0, at + margin)}
        member = interval.member()
        if taken < interval.inside:
            member = F.when(F.col("_random") < F.lit(taken / interval.inside), member)
        members.append(member.alias(f"m{k}"))
        sketches.append(F.percentile_approx(f"m{k}", sorted(points), ACCURACY).alias(f"c{k}"))
    row = df.select("*", F.rand(seed).alias("_random")).select(members).agg(*sketches).first()
    return [sorted(set(row[f"c{k}"] or [])) for k in range(len(intervals))]


def _place(member: Column, cuts: list[float]) -> Column:
    """2j for a value between cut j-1 and cut j, 2j+1 for a value equal to cut j."""
    place = None
    for j, cut in enumerate(cuts):
        below, equal = member < F.lit(cut), member == F.lit(cut)
        place = F.when(below, 2 * j) if place is None else place.when(below, 2 * j)
        place = place.when(equal, 2 * j + 1)
    return place.when(member.isNotNull(), 2 * len(cuts))


def _tally(df: DataFrame, intervals: list[Interval], cuts: list[list[float]]) -> dict[tuple[int, int], int]:
    """Exact number of values per (interval, place); a few records per task are shuffled."""
    members = df.select([x.member().alias(f"m{k}") for k, x in enumerate(intervals) if cuts[k]])
    used = [k for k in range(len(intervals)) if cuts[k]]
    places = members.select([_place(F.col(f"m{k}"), cuts[k]).alias(f"p{k}") for k in used])
    pairs = ", ".join(f"{k}, p{k}" for k in used)
    rows = (
        places.selectExpr(f"stack({len(used)}, {pairs}) as (interval, place)")
        .where(F.col("place").isNotNull())
        .groupBy("interval", "place")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    return {(r["interval"], r["place"]): r["n"] for r in rows}


def _narrow(
    df: DataFrame, intervals: list[Interval], cuts: list[list[float]], found: dict[int, dict[int, float]]
) -> list[Interval]:
    """Settle the ranks that hit a cut; keep the gap between two cuts for each of the others."""
    tally = _tally(df, intervals, cuts)
    remaining: dict[tuple, Interval] = {}
    for k, (interval, values) in enumerate(zip(intervals, cuts)):
        if not values:
            remaining[(k,)] = interval
            continue
        bounds = [interval.low, *values, interval.high]
        for rank in interval.ranks:
            start = interval.below
            for place in range(2 * len(values) + 1):
                size = tally.get((k, place), 0)
                if rank < start + size:
                    break
                start += size
            j, equal = divmod(place, 2)
            if equal:
                found[interval.info.ordinal][rank] = values[j]
                continue
            gap = remaining.setdefault((k, j), Interval(interval.info, bounds[j], bounds[j + 1], start, size))
            gap.ranks.append(rank)
    return list(remaining.values())


def _read_leaves(df: DataFrame, leaves: list[Interval], found: dict[int, dict[int, float]]) -> None:
    """Order the few values left in each interval and read off the wanted ranks."""
    pairs = ", ".join(f"{k}, m{k}" for k in range(len(leaves)))
    counts = (
        df.select([leaf.member().alias(f"m{k}") for k, leaf in enumerate(leaves)])
        .selectExpr(f"stack({len(leaves)}, {pairs}) as (leaf, value)")
        .where(F.col("value").isNotNull())
        .groupBy("leaf", "value")
        .agg(F.count("*").alias("cnt"))
    )
    # A leaf holds at most leaf_rows rows, so the window partition is bounded.
    last = F.sum("cnt").over(W.partitionBy("leaf").orderBy("value"))
    placed = counts.withColumn("last", last).withColumn("first", F.col("last") - F.col("cnt"))
    wanted = None
    for k, leaf in enumerate(leaves):
        for rank in leaf.ranks:
            local = F.lit(rank - leaf.below)
            test = (F.col("leaf") == k) & (F.col("first") <= local) & (local < F.col("last"))
            wanted = test if wanted is None else wanted | test
    for row in placed.where(wanted).collect():
        leaf = leaves[row["leaf"]]
        for rank in leaf.ranks:
            if row["first"] <= rank - leaf.below < row["last"]:
                found[leaf.info.ordinal][rank] = row["value"]


def approximate_quantiles(df: DataFrame, probabilities: tuple[float, ...] = QUARTILES) -> DataFrame:
    """Opt-in variant: mergeable sketches of all rows, in one scan."""
    infos = [i for i in column_infos(df) if i.kind == NUMERIC]
    if not infos:
        return small_frame(df.sparkSession, [], RESULT_SCHEMA)
    agg = df.agg(
        *[
            F.percentile_approx(i.value.cast("double"), list(probabilities), ACCURACY).alias(f"q{i.ordinal}")
            for i in infos
        ]
    )
    records = [F.struct(F.lit(i.ordinal).alias("ordinal"), F.col(f"q{i.ordinal}").alias("quantiles")) for i in infos]
    return agg.select(F.inline(F.array(*records)))
