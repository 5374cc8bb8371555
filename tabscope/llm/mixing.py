"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source has a target number of words. Its documents fall into blocks by hash, and
the blocks stand in a random order. A target of f + r times the source draws f whole
rounds of all blocks and, for r, the first blocks of the order, with the last of them
cut between documents, so that the words drawn come as near to the target as whole
documents allow. Drawn blocks are dealt to output shards by a splitting tree: the
exact quotas of all sources at a node are split between its two halves by a
multivariate-hypergeometric draw, down to the shards; so every shard gets a random
but exact share and no block is drawn twice for one place. In a shard the documents
of its blocks are shuffled locally.

All random choices are hashes or seeded draws: runs agree whatever the partitions.

One row per source, with one number per shard, is all that the driver holds. The cut
is found by narrowing the order of a source, 1,024 parts at a time, so no task sorts
the documents of a source.

Defined cases: a null text has no words; a null source is a source of its own, the
last one; sources without words have the target 0 and are not drawn; documents without
words follow their block; repeated rows (equal id and text) have one place in the order
and are drawn equally often; an empty table gives no rows; further columns are passed
through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import count_words, saved, text_of
from tabscope.session import small_frame

#: Fixed values of the contract.
WEIGHTS, SHARE, MOST_TIMES = (3, 1, 2), 1.5, 2
#: Bits of a document's place in the order of its source, and bits of one narrowing step.
KEY_BITS, STEP_BITS = 60, 10
#: A source has up to 2^10 blocks, of this many words where it has fewer.
BLOCK_BITS, BLOCK_WORDS = 10, 16_384
SHARDS, SEED = 64, 7
#: Words of a shard that one task writes.
PIECE_WORDS = 16_000_000
SOURCES = "_source string, _size long, _target double, _rounds int, _cut long, _bits int, _offsets array<long>"


@dataclass
class Source:
    """One source: its words, what the mix takes, and the end of the last round."""

    name: str | None
    size: int
    target: float
    cut: int = 0
    prefix: int = 0
    need: float = 0.0

    @property
    def rounds(self) -> int:
        return int(self.target // self.size) if self.size else 0

    @property
    def bits(self) -> int:
        return min(BLOCK_BITS, max(0, self.size // BLOCK_WORDS).bit_length())

    @property
    def quota(self) -> int:
        """Drawn blocks: all of each whole round, and those of the last round up to the cut."""
        part = ((self.cut - 1) >> (KEY_BITS - self.bits)) + 1 if self.cut else 0
        return (self.rounds << self.bits) + part


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST_TIMES) -> dict:
    """Target words by source: shares by weight, held at ``most`` times the size.

    What is held back is shared again by weight until no target is above its limit.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if each * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: each * weight[s] for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(sources, shards): exact block quotas of each shard, by recursive halving."""
    out = np.zeros((len(quotas), shards), np.int64)
    total = int(quotas.sum())

    def go(have: np.ndarray, first: int, many: int, path: int) -> None:
        if many == 1:
            out[:, first] = have
            return
        half, places = many // 2, int(have.sum())
        # places of the left half: all shards get the same number, the first ones one more
        start = total // shards * first + min(first, total % shards)
        middle = first + half
        want = total // shards * middle + min(middle, total % shards) - start
        draw = np.random.default_rng([seed, path]).multivariate_hypergeometric(have, min(want, places), method="marginals")
        go(draw, first, half, 2 * path)
        go(have - draw, middle, many - half, 2 * path + 1)

    if len(quotas):
        go(quotas.astype(np.int64), 0, shards, 1)
    return out


def keyed(docs: DataFrame, id_col: str, source: str, text: str, seed: int) -> DataFrame:
    """``docs`` with ``_size`` in words and ``_key``, the place in the order of its source."""
    t = text_of(f"`{text}`")
    return docs.withColumn("_size_of", count_words(t)).withColumn(
        "_key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col("_size_of"), t), 64 - KEY_BITS)
    )


def _find_cuts(rows: DataFrame, sources: list[Source]) -> None:
    """Set ``cut`` of each source so that documents before it have about ``need`` words.

    A step sums the words of the 1,024 parts of the part of the order in which the end
    lies, and goes into the part that holds it, until that part is one document. One
    row per source comes back; the steps grow with the logarithm of the documents.
    """
    spark = rows.sparkSession
    open_ = {i: s for i, s in enumerate(sources) if s.need > 0}
    shift = KEY_BITS
    while open_:
        shift -= STEP_BITS
        state = small_frame(
            spark,
            [(i, s.name, s.prefix, s.need) for i, s in open_.items()],
            "_s int, _source string, _prefix long, _need double",
        )
        order = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = (
            rows.join(state, F.col("source").eqNullSafe(F.col("_source")))
            .where(F.shiftright("_key", shift + STEP_BITS) == F.col("_prefix"))
            .groupBy("_s", "_need", F.shiftright("_key", shift).alias("_part"))
            .agg(F.sum("_size_of").alias("_words"), F.count("*").alias("_rows"))
            .withColumn("_upto", F.sum("_words").over(order))  # at most 1,024 rows a source
            .where((F.col("_upto") > F.col("_need")) & (F.col("_upto") - F.col("_words") <= F.col("_need")))
        )
        for r in found.collect():
            s = open_[r["_s"]]
            s.prefix, s.need = r["_part"], s.need - (r["_upto"] - r["_words"])
            if r["_rows"] == 1 or shift == 0:
                s.cut = (s.prefix + (1 if 2 * s.need >= r["_words"] else 0)) << shift
                del open_[r["_s"]]


def source_table(docs_keyed: DataFrame, seed: int, shards: int) -> DataFrame:
    """One row per source: size, target, whole rounds, cut, and block offsets by shard."""
    spark = docs_keyed.sparkSession
    totals = docs_keyed.groupBy("source").agg(F.sum("_size_of").alias("n")).collect()
    sizes = {r["source"]: r["n"] for r in totals}
    wanted = targets(sizes)
    sources = [Source(name, size, wanted[name]) for name, size in sizes.items()]
    sources.sort(key=lambda s: (s.name is None, s.name or ""))
    for s in sources:
        s.need = s.target - s.rounds * s.size
    _find_cuts(docs_keyed, sources)
    quotas = split_quotas(np.array([s.quota for s in sources], np.int64), shards, seed)
    offsets = np.concatenate([np.zeros((len(sources), 1), np.int64), quotas.cumsum(axis=1)], axis=1)
    rows = [(s.name, s.size, s.target, s.rounds, s.cut, s.bits, o) for s, o in zip(sources, offsets.tolist())]
    return small_frame(spark, rows, SOURCES)


def draw(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``times`` and ``shards``.

    ``times`` is how often the mix takes the row, ``shards`` the output shard of each
    copy. Sizes and places are computed once more from the rows for the result; the
    narrow table of them serves the totals and the narrowing steps. ``options`` are those
    of ``_drawn``.
    """
    return _drawn(docs, **options)[0]


def _drawn(
    docs: DataFrame,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    shards: int = SHARDS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``draw`` and the table of sources."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    wide = keyed(
        docs.select(own, F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("_text")),
        "_id", "source", "_text", seed,
    )
    narrow = saved(wide.select("source", "_key", "_size_of"), "sizes")
    table = source_table(narrow, seed, shards)
    times = F.col("_rounds") + F.when(F.col("_key") < F.col("_cut"), 1).otherwise(0)
    rows = (
        wide.join(table, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("times", times.cast("int"))
        .withColumn("_block", F.call_function("shiftright", F.col("_key"), F.lit(KEY_BITS) - F.col("_bits")))
        .withColumn(
            "shards",
            F.transform(
                F.when(F.col("times") > 0, F.sequence(F.lit(0), F.col("times") - 1)).otherwise(F.array().cast("array<int>")),
                lambda r: F.size(
                    F.filter(
                        "_offsets",
                        lambda o: o <= F.call_function("shiftleft", r.cast("long"), F.col("_bits")) + F.col("_block"),
                    )
                ) - 1,
            ),
        )
        .select("_doc", F.col("_size_of").alias("size"), F.col("_size").alias("source_size"), F.col("_target").alias("target"), "times", "shards", "_key")
    )
    return rows, table


def pieces_of(words: float, shards: int, piece_words: int = PIECE_WORDS) -> int:
    """Tasks that write a shard of a mix of so many words."""
    return max(1, math.ceil(words / shards / piece_words))


def mixed(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, piece_words: int = PIECE_WORDS, **columns: str
) -> DataFrame:
    """The mix: rows of ``docs`` as often as they are drawn, by shard, shuffled in each.

    A shard of more than ``piece_words`` words is written by several tasks: its shuffled
    order is dealt to them by hash, so no task grows with the corpus.
    """
    rows, table = _drawn(docs, shards=shards, seed=seed, **columns)
    pieces = pieces_of(table.agg(F.coalesce(F.sum("_target"), F.lit(0.0))).first()[0], shards, piece_words)
    order = F.xxhash64(F.lit(seed), "_copy", "_key")
    copies = rows.select("_doc", "_key", F.posexplode("shards").alias("_copy", "_shard"))
    keys = ["_shard"] if pieces == 1 else ["_shard", F.pmod(order, F.lit(pieces))]
    # AQE may merge small partitions of the default number; many pieces need their own number
    dealt = copies.repartition(*keys) if pieces == 1 else copies.repartition(shards * pieces, *keys)
    return dealt.sortWithinPartitions(*keys, order).select("_doc.*")
