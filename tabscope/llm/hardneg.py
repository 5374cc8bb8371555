"""Hard-negative mining by a vertical scan in each anchor's order of dimensions (BOND).

Vectors lie in columns, one row of numbers per dimension. An anchor reads dimensions in
the order of its own magnitudes, greatest first, a block at a time. What the dimensions
not yet read can still add lies between two sums: per dimension the least and greatest
product of the anchor's component with the column's minimum and maximum. With them a
bitmap of candidates shrinks after every block.

Two scans resolve the windows. The first finds each anchor's positives, the k rows of
its label with the highest scores: candidates leave whose upper bound is below the k-th
lower bound. With the positives known, each of them opens a window of scores; the second
scan keeps, among rows of other labels, those whose bounds touch a window, and of those
that are surely inside it only such as can still be among the first. Scores are whole
numbers, so what is left is ranked exactly.

Anchors meet candidates in cells of a grid, candidate slices times anchor slices, both of
bounded size and dealt by row, so that no label, value or id makes a cell large. A cell
yields a bounded number of rows per anchor. Anchors are a stated query set; the work is
anchors times rows, as in every exact search.

Defined cases: rows with a null id or label, with a null or empty vector or with a null
or non-finite component take no part; vectors meet only those of their own length; the
anchor's own row is every row with its id; repeated rows count as often as they come,
a repeated anchor asks once for each of its rows; ties go to the smaller id; an anchor
without a positive, and a positive without a negative in its window, have no rows. Where
components are so large that doubles could round, the pairs concerned are computed in
whole numbers of any size; scores beyond 64 bits are held at the least or greatest one,
and windows are taken from scores so held. An empty table gives no rows; further columns
are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import saved

#: Rows of a cell's candidate and anchor slice, on average; dimensions read between two looks at the bitmap.
CANDIDATE_SLICE, ANCHOR_SLICE, BLOCK = 65_536, 4_096, 16
LOW, HIGH = -(2**63), 2**63 - 1


class Mining(NamedTuple):
    """Positives per anchor, negatives per positive, and the window in hundredths of the positive's score."""

    positives: int = 5
    negatives: int = 3
    least: int = 50
    most: int = 95


def window(score: int, mining: Mining) -> tuple[int, int]:
    """Whole scores s with least * score <= 100 * s <= most * score: from, to; empty if from > to."""
    return -((-mining.least * score) // 100), (mining.most * score) // 100


class Slice(NamedTuple):
    """Candidates of one vector length in vertical layout."""

    ids: np.ndarray
    labels: np.ndarray
    numbers: np.ndarray  # (dimension, row)
    large: np.ndarray  # rows whose products doubles could round
    low: np.ndarray  # least and greatest number of each dimension in the other rows
    high: np.ndarray

    def only(self, rows: np.ndarray) -> Slice:
        return _slice(self.ids[rows], self.labels[rows], np.ascontiguousarray(self.numbers[:, rows]))


def _slice(ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray) -> Slice:
    large = np.abs(numbers).max(axis=0) > exact_bound(len(numbers))
    small = numbers[:, ~large] if large.any() else numbers
    if not small.shape[1]:
        small = np.zeros((len(numbers), 1))
    return Slice(ids, labels, numbers, large, small.min(axis=1), small.max(axis=1))


def exact_bound(dims: int) -> float:
    """Components up to this bound have exact inner products in doubles, partial ones too."""
    return math.floor(math.sqrt(2.0**53 / max(dims, 1)))


def slices(ids: pa.Array, labels: pa.Array, vectors: pa.Array) -> dict[int, tuple[Slice, np.ndarray]]:
    """By vector length: the rows of that length, and their places."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets = vectors.offsets.to_numpy()
    flat, sizes = vectors.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    ids, labels = ids.to_numpy(), labels.to_numpy()
    found = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        numbers = np.ascontiguousarray(flat[offsets[rows][:, None] + np.arange(d)].T)
        found[int(d)] = _slice(ids[rows], labels[rows], numbers), rows
    return found


def scan(anchor: np.ndarray, part: Slice, alive: np.ndarray, shrink: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the candidates that ``shrink`` leaves in the bitmap ``alive``.

    ``shrink(scores, least more, most more)`` sees what the unread dimensions can add and
    says which candidates stay.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = anchor * part.low, anchor * part.high
    least, most = (np.append(np.cumsum(f(*ends)[order][::-1])[::-1], 0.0) for f in (np.minimum, np.maximum))
    at = np.flatnonzero(alive)
    scores = np.zeros(len(at))
    for first in range(0, len(order), BLOCK):
        dims = order[first : first + BLOCK]
        # picking candidates out of a column costs more than a few products too many
        if 4 * len(at) > len(alive):
            scores += (anchor[dims] @ part.numbers[dims])[at]
        else:
            scores += anchor[dims] @ part.numbers[np.ix_(dims, at)]
        read = min(first + BLOCK, len(order))
        stay = shrink(scores, least[read], most[read])
        if stay is not None and not stay.all():
            at, scores = at[stay], scores[stay]
            if not len(at):
                break
    return at, scores


def whole_scores(anchor: np.ndarray, numbers: np.ndarray) -> list[int]:
    """Inner products in whole numbers of any size, held within 64 bits."""
    a = [int(x) for x in anchor]
    return [min(max(sum(x * int(y) for x, y in zip(a, column)), LOW), HIGH) for column in numbers.T]


def first_of(pairs: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k first (score, id) by score descending, id ascending."""
    return sorted(pairs, key=lambda p: (-p[0], p[1]))[:k]


def _chosen(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    best = np.lexsort((ids, -scores))[:k]
    return [(int(scores[i]), int(ids[i])) for i in best]


def _pairs(anchor: np.ndarray, part: Slice, allowed: np.ndarray, shrink: Callable, large: bool):
    """((ids, scores) by the scan, [(score, id)] in whole numbers) of the allowed candidates."""
    outside = allowed & (part.large | large)
    slow = list(zip(whole_scores(anchor, part.numbers[:, outside]), part.ids[outside].tolist())) if outside.any() else []
    inside = allowed & ~part.large if not large else np.zeros_like(allowed)
    if not inside.any():
        return (part.ids[:0], np.zeros(0)), slow
    at, scores = scan(anchor, part, inside, shrink)
    return (part.ids[at], scores), slow


def positives_of(anchor: np.ndarray, anchor_id: int, part: Slice, k: int, large: bool) -> list[tuple[int, int]]:
    """The k first (score, id) among ``part``, rows of the anchor's label."""

    def shrink(scores, least, most):
        if len(scores) <= k:
            return None
        # every bound is the score and one sum, so the k-th greatest score decides
        return scores + most >= np.partition(scores, len(scores) - k)[len(scores) - k] + least

    (ids, scores), slow = _pairs(anchor, part, part.ids != anchor_id, shrink, large)
    return first_of(_chosen(ids, scores, k) + slow, k)


def negatives_of(
    anchor: np.ndarray, part: Slice, allowed: np.ndarray, windows: list[tuple[int, int]], k: int, large: bool
) -> list[list[tuple[int, int]]]:
    """For each window the k first (score, id) of the allowed rows of ``part`` inside it."""
    bounds = sorted((float(a), float(b)) for a, b in windows)
    spans: list[list[float]] = []  # windows that overlap, joined
    for low, high in bounds:
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    widest = max(high - low for low, high in bounds)

    def near(scores, least, most, low, high):
        return (scores >= low - most) & (scores <= high - least)

    def shrink(scores, least, most):
        if most - least > widest:  # nothing is surely inside a window yet
            stay = near(scores, least, most, *spans[0])
            for span in spans[1:]:
                stay |= near(scores, least, most, *span)
            return stay
        stay = np.zeros(len(scores), bool)
        for low, high in bounds:
            touched = near(scores, least, most, low, high)
            inside = scores[touched]
            sure = inside[(inside >= low - least) & (inside <= high - most)]
            if len(sure) > k:
                touched &= scores >= np.partition(sure, len(sure) - k)[len(sure) - k] + least - most
            stay |= touched
        return stay

    (ids, scores), slow = _pairs(anchor, part, allowed, shrink, large)
    out = []
    for low, high in windows:
        inside = (scores >= low) & (scores <= high)
        out.append(first_of(_chosen(ids[inside], scores[inside], k) + [p for p in slow if low <= p[0] <= high], k))
    return out


def quantised(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v, row): floor(scale * x) as doubles, of rows that take part."""
    scaled = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x * scale)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() ends at 64 bits; doubles from 2^53 on are whole already
    floor = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), scaled.alias("v")
    )
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite
    return rows.where(usable).select("vec_id", "label", F.transform("v", floor).alias("v"), F.monotonically_increasing_id().alias("row"))


class Grid(NamedTuple):
    """Slices of the candidates times slices of the anchors; cell = across * down + place."""

    across: int
    down: int

    def candidates(self, rows: DataFrame) -> DataFrame:
        deal = F.pmod(F.xxhash64("row"), F.lit(self.across))
        cells = F.transform(F.sequence(F.lit(0), F.lit(self.down - 1)), lambda place: deal * self.down + place)
        return rows.select(F.explode(cells).alias("cell"), F.col("vec_id").alias("c_id"), F.col("label").alias("c_label"), F.col("v").alias("c_v"))

    def anchors(self, rows: DataFrame, *more: str) -> DataFrame:
        deal = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(self.down))
        cells = F.transform(F.sequence(F.lit(0), F.lit(self.across - 1)), lambda across: across * self.down + deal)
        return rows.select(F.explode(cells).alias("a_cell"), "row", "vec_id", "label", "v", *more)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    mining: Mining = Mining(),
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    # written once: both scans and both sides of a cell read the same rows
    rows = saved(quantised(vectors, id_col, label_col, vector_col, scale), "vectors")
    asked = rows.where(is_anchor)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("a")).first()
    down = max(1, math.ceil(counts["a"] / ANCHOR_SLICE))
    # few vectors must still keep all executors busy: narrower slices, same answer
    busy = math.ceil(spark.sparkContext.defaultParallelism / down)
    grid = Grid(max(1, math.ceil(counts["n"] / CANDIDATE_SLICE), busy), down)
    candidates = grid.candidates(rows).groupBy("cell")

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        parts = slices(left.column("c_id"), left.column("c_label"), left.column("c_v")) if left.num_rows else {}
        asked_rows = right.column("row").to_pylist()
        for dims, (anchors, places) in (slices(right.column("vec_id"), right.column("label"), right.column("v")) if right.num_rows else {}).items():
            if dims not in parts:
                continue
            whole = parts[dims][0]
            for label in np.unique(anchors.labels):
                same = np.flatnonzero(whole.labels == label)
                if not len(same):
                    continue
                part = whole.only(same)
                for j in np.flatnonzero(anchors.labels == label):
                    found = positives_of(anchors.numbers[:, j], anchors.ids[j], part, mining.positives, bool(anchors.large[j]))
                    out += [(asked_rows[places[j]], i, s) for s, i in found]
        columns = list(zip(*out)) or [()] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("row", "positive_id", "positive_score"), columns)})

    found = candidates.cogroup(grid.anchors(asked).groupBy("a_cell")).applyInArrow(
        find_positives, "row long, positive_id long, positive_score long"
    )
    best = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    chosen = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= mining.positives)
    positives = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    with_positives = saved(asked.join(positives, "row"), "positives")

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        parts = slices(left.column("c_id"), left.column("c_label"), left.column("c_v")) if left.num_rows else {}
        asked_rows, known = right.column("row").to_pylist(), right.column("positives").to_pylist()
        for dims, (anchors, places) in (slices(right.column("vec_id"), right.column("label"), right.column("v")) if right.num_rows else {}).items():
            if dims not in parts:
                continue
            part = parts[dims][0]
            for label in np.unique(anchors.labels):
                other = part.labels != label
                for j in np.flatnonzero(anchors.labels == label):
                    mine_ = [(p, window(p["positive_score"], mining)) for p in known[places[j]]]
                    mine_ = [(p, w) for p, w in mine_ if w[0] <= w[1]]
                    if not mine_ or not other.any():
                        continue
                    lists = negatives_of(anchors.numbers[:, j], part, other, [w for _, w in mine_], mining.negatives, bool(anchors.large[j]))
                    for (p, _), found in zip(mine_, lists):
                        row = asked_rows[places[j]], int(anchors.ids[j]), p["place"], p["positive_id"], p["positive_score"]
                        out += [(*row, i, s) for s, i in found]
        columns = list(zip(*out)) or [()] * 7
        names = "row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    schema = "row long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = candidates.cogroup(grid.anchors(with_positives, "positives").groupBy("a_cell")).applyInArrow(find_negatives, schema)
    hardest = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(hardest).cast("int"))
        .where(F.col("rank") <= mining.negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
