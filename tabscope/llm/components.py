"""Connected components of an edge table, by alternating large and small stars.

No node's neighbours are ever gathered: a round takes the least neighbour of each node
(combined in each task) and joins it back to the edges, where Spark splits hot nodes.
Each round is written to the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h % 1_000_003), F.bit_xor(h)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, roots included; ``edges`` has (a, b).

    Loops and repeated edges are fine; null ends make no edge. The root is the least
    node of its component. The rounds grow with the logarithm of the longest chain.
    """
    edges = saved(edges.where("a <> b").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        # two small tables per round; the write keeps plans and lineage short
        edges = saved(_small_star(_large_star(edges)).where("a <> b").distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
