"""Exact top-k by inner product: columnar branch and bound over blocks of dimensions.

Vectors lie in vertical layout, one row of numbers per dimension. For a query, scores
of all candidates grow dimension block by dimension block; after each block, what the
remaining dimensions can still add is bounded by the product of the remaining lengths
(Cauchy-Schwarz). Candidates whose bound is below the k-th best score known so far
leave, and the arrays are compacted. Scores are integers, so the answer is exact.

The stated queries meet all candidates in cells of a grid: candidate slices times
query slices, both of bounded size. A cell yields k rows per query; a window over at
most k rows per cell and query ranks them.

Defined cases: vectors that are null, empty or hold null or non-finite components take
no part; a query meets only candidates of its own length; a query's own row is every
row with its id; repeated rows count as often as they come; ids that are null take no
part; with no candidate a query has no row; ties go to the smaller id. Scores outside
64 bits are held at the least or greatest 64-bit number.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a cell's candidate and query slice, on average.
CANDIDATE_SLICE, QUERY_SLICE = 65_536, 4_096
BLOCK = 8
CELL_SCHEMA = "query_row long, query_id long, vec_id long, score long"
EXACT_FLOAT = 2.0**53
#: Numbers whose squares are far from the greatest double.
LONGEST = 2.0**400


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) as double, for vectors that take part."""
    scaled = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x * scale)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), scaled.alias("v"))
    # floor() ends at 64 bits; doubles from 2^53 on are whole already
    whole = lambda x: F.when(F.abs(x) < EXACT_FLOAT, F.floor(x).cast("double")).otherwise(x)
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite).select(
        "vec_id", F.transform("v", whole).alias("v")
    )


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of vector: ids, numbers in vertical layout (dimension, row), row places."""
    if not table.num_rows:
        return {}
    lists = table.column("v").combine_chunks()
    ids = table.column("vec_id").to_numpy()
    sizes = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    out = {}
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out[int(d)] = ids[rows], np.ascontiguousarray(flat[starts[rows][:, None] + np.arange(d)].T), rows
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id ascending)."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= floor)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def search_block(query: np.ndarray, query_id: int, ids: np.ndarray, vertical: np.ndarray, rest: np.ndarray, k: int):
    """Exact top k of one query among candidates in vertical layout.

    ``rest[b]`` holds each candidate's length over the dimensions from block b on.
    """
    dims = len(query)
    mass = np.sqrt(np.concatenate([np.cumsum((query**2)[::-1])[::-1], [0.0]]))
    alive = np.flatnonzero(ids != query_id)
    score = np.zeros(len(alive))
    for b, start in enumerate(range(0, dims, BLOCK)):
        stop = min(start + BLOCK, dims)
        part = vertical[start:stop]
        score += query[start:stop] @ (part if len(alive) == vertical.shape[1] else part[:, alive])
        if stop < dims and len(alive) > 4 * k:
            slack = mass[stop] * rest[b + 1][alive]
            # the k-th best lower bound; bounds are widened against rounding
            least = score - slack
            floor = np.partition(least, len(least) - k)[len(least) - k]
            stay = score + slack >= floor - 1e-6 * (1 + abs(floor))
            if stay.sum() < 0.8 * len(alive):
                alive, score = alive[stay], score[stay]
    top = _best(score, ids[alive], k)
    return ids[alive][top], score[top]


def _large_scores(query: np.ndarray, query_id: int, ids: np.ndarray, vertical: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(minus score, id) of the k best in Python's integers, where doubles could round."""
    q = [int(x) for x in query]
    found = ((-sum(a * int(b) for a, b in zip(q, vertical[:, j])), int(i)) for j, i in enumerate(ids) if i != query_id)
    return heapq.nsmallest(k, found)


class Candidates:
    """Candidates of one length in vertical layout, ready for queries of any size.

    A pair is large if its products could pass what doubles hold exactly. For a query,
    the large candidates are those of the greatest numbers, so a cut by size parts them
    from the others; the others of the last cut are kept for the queries that follow.
    """

    def __init__(self, ids: np.ndarray, vertical: np.ndarray):
        self.ids, self.vertical = ids, vertical
        self.greatest = np.abs(vertical).max(axis=0, initial=0.0)
        self.large, self.small = np.zeros(0, np.int64), None

    def _cut(self, query: np.ndarray):
        size = np.abs(query).max(initial=0.0) * len(query)
        with np.errstate(over="ignore"):
            # lengths must stay finite too, of the query and of each candidate
            least = EXACT_FLOAT / size if size else np.inf
            large = np.flatnonzero(self.greatest >= min(least, LONGEST)) if size < LONGEST else np.arange(len(self.ids))
        if self.small is None or len(large) != len(self.large):
            self.large = large
            columns = self.vertical if not len(large) else np.delete(self.vertical, large, axis=1)
            rest = [np.sqrt((columns[s:] ** 2).sum(axis=0)) for s in range(0, len(columns), BLOCK)]
            self.small = np.delete(self.ids, large), columns, rest

    def search(self, query: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best, in order; scores are held at 64 bits."""
        self._cut(query)
        found = []
        if len(self.small[0]):
            found = [(-int(s), int(i)) for i, s in zip(*search_block(query, query_id, *self.small, k))]
        if len(self.large):
            found += _large_scores(query, query_id, self.ids[self.large], self.vertical[:, self.large], k)
        low, high = -(2**63), 2**63 - 1
        return [(i, min(max(-s, low), high)) for s, i in sorted(found)[:k]]


def search_cell(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    keys = dict(zip(range(queries.num_rows), queries.column("query_row").to_pylist()))
    found_rows, vertical, by_length = [], _matrices(candidates), _matrices(queries)
    for dims, (query_ids, numbers, places) in by_length.items():
        if dims not in vertical:
            continue
        candidates_of_length = Candidates(*vertical[dims][:2])
        # queries of one size after the other meet the same cut
        for j in np.argsort(np.abs(numbers).max(axis=0), kind="stable"):
            found = candidates_of_length.search(numbers[:, j], query_ids[j], k)
            found_rows += [(keys[places[j]], int(query_ids[j]), i, s) for i, s in found]
    columns = list(zip(*found_rows)) or [()] * 4
    return pa.table({f: pa.array(c, pa.int64()) for f, c in zip(("query_row", "query_id", "vec_id", "score"), columns)})


def top_k(
    vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row.

    ``is_query`` is a condition on ``vec_id``. Rows are dealt to slices by row, so no
    value or id makes a slice large. The number of slices follows the number of rows.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    down = max(1, math.ceil(counts["q"] / QUERY_SLICE))
    # few vectors must still keep all executors busy: narrower slices, same answer
    busy = math.ceil(vectors.sparkSession.sparkContext.defaultParallelism / down)
    across = max(1, math.ceil(counts["n"] / CANDIDATE_SLICE), busy)
    dealt = rows.withColumn("query_row", F.monotonically_increasing_id())
    deal = lambda slices: F.pmod(F.xxhash64("query_row"), F.lit(slices))
    cell = lambda a, b: (a * down + b).alias("cell")
    candidates = dealt.withColumn("_down", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).select(
        cell(deal(across), F.col("_down")), "vec_id", "v"
    )
    # other names than the candidates': Spark prunes a column that both sides share
    # as soon as the caller reads less than every column
    queries = (
        dealt.where(is_query)
        .withColumn("_across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
        .select(
            cell(F.col("_across").cast("long"), deal(down)).alias("query_cell"),
            "query_row",
            F.col("vec_id").alias("query_id"),
            F.col("v").alias("query_v"),
        )
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_cell(left, right.rename_columns(["cell", "query_row", "vec_id", "v"]), k)

    found = candidates.groupBy("cell").cogroup(queries.groupBy("query_cell")).applyInArrow(run, CELL_SCHEMA)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
