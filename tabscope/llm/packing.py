"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

A document is its token ids and one end id. Only documents longer than the capacity
are cut: from the end into full pieces, so the first piece may be shorter.

Packing is bulk-synchronous best fit. Documents and gaps are kept sorted by size.
In a superstep all documents of the greatest unplaced length look for their successor,
the smallest gap that holds them; equal documents and equal gaps are matched by rank,
the first document with the first gap, so no two documents get one gap; the gaps
shrink and the sweep goes on until no document or no gap is left; what is left opens
new sequences. Lengths and gaps are whole numbers up to the capacity, so both sorted
lists are held as runs of equal size: a superstep costs the number of runs, whatever
the number of documents. The runs of lengths come from one aggregate, the documents
find their place by (length, rank) afterwards, all of them in parallel: they are
sorted by length and counted over range partitions, so that a length which most
documents share is spread over many tasks.

Defined cases: a null text is an empty one and makes a document of the end id alone;
repeated rows and null ids are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import os
import zlib
from array import array
from bisect import bisect_left, insort
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import map_columns, saved, text_of, texts
from tabscope.session import small_frame

CAPACITY, END_ID = 2048, 0
#: Chunks whose ids a worker remembers, at 200 bytes or so; it holds them through later stages too.
REMEMBERED = 131_072
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids as little-endian bytes, chunk by chunk between single spaces.

    A byte-level BPE with the usual splitting pattern never joins what stands before a
    single space with what follows, so " word" has the same ids in every text and most
    chunks are found in a dictionary. New chunks are encoded from the same vocabulary
    given as ranks, which costs a third for short strings. Texts with white space around
    a single space, or with a special token, go through the tokenizer whole.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, ranked = self.known, self.ranked.encode_ordinary
        for c in chunks.difference(known):
            plain = c and not c[0].isspace() and not c[-1].isspace()
            known[c] = array("I", ranked(" " + c)).tobytes() if plain else None

    def encode(self, batch: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in batch]
        self._learn({c for chunks in split for c in chunks})
        out = []
        for text, (head, *chunks) in zip(batch, split):
            rest = [self.known[c] for c in chunks]
            odd = None in rest or head[-1:].isspace() or any(s in text for s in self.special)
            first = b"" if odd else array("I", self.ranked.encode_ordinary(head)).tobytes()
            out.append(self._whole(text) if odd else first + b"".join(rest))
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*paths: str) -> Encoder:
    """One encoder for each worker process; its dictionary stays warm between tasks."""
    if paths not in _ENCODERS:
        _ENCODERS[paths] = Encoder(*paths)
    return _ENCODERS[paths]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])) for a, b in zip(edges, edges[1:])]


class Tokens(NamedTuple):
    """Where a public tokenizer lies: its file, the same vocabulary as ranks, the splitting pattern."""

    path: str
    ranks_path: str
    pattern: str


def tokenised_pieces(docs: DataFrame, tokens: Tokens, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document, without the ids themselves."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batch, state: Encoder) -> dict:
        rows = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), state.encode(texts(batch))):
            rows += [(doc_id, i, *p) for i, p in enumerate(cut(ids + end, capacity))]
        columns = list(zip(*rows)) or [()] * 5
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, columns)))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_columns(narrow, run, PIECES, lambda: encoder(*tokens), rows=128)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, documents, first sequence, offset, documents per sequence).

    ``counts`` has the number of documents of each length. Document ``first rank + i``
    goes to sequence ``first sequence + i // per`` at ``offset + (i % per) * length``.
    A run of gaps is (gap, first sequence, sequences): sequences of one fill, numbered
    in a row.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    runs, opened = [], 0

    def add(gap: int, first: int, many: int) -> None:
        if gap and many:
            if not gaps.get(gap):
                gaps[gap] = []
                insort(sizes, gap)
            heapq.heappush(gaps[gap], (first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)  # the successor sweep
            if at == len(sizes):
                break
            gap = sizes[at]
            first, many = heapq.heappop(gaps[gap])
            if not gaps[gap]:
                sizes.pop(at)
            taken = min(many, left)
            runs.append((length, rank, taken, first, capacity - gap, 1))
            add(gap, first + taken, many - taken)
            add(gap - length, first, taken)
            rank, left = rank + taken, left - taken
        if left:
            per = capacity // length
            full, rest = divmod(left, per)
            runs.append((length, rank, left, opened, 0, per))
            add(capacity - per * length, opened, full)
            add(capacity - rest * length, opened + full, 1 if rest else 0)
            opened += full + (1 if rest else 0)
    return runs


def with_ranks(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``pieces`` with ``rank``, from 0 within each length, and the rows of each length.

    Rows are written in range partitions sorted by length; a row's rank is its place in
    its partition plus the rows of its length in the partitions before.
    """
    spark = pieces.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    ordered = (
        pieces.withColumn("_s", spread)
        .repartitionByRange(parts, "length", "_s")
        .sortWithinPartitions("length", "_s")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
        .drop("_s")
    )
    ordered = saved(ordered, "pieces")
    runs = ordered.groupBy("length", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    rows = sorted((r["length"], r["_part"], r["_n"], r["_first"]) for r in runs.collect())
    before, seen = [], {}
    for length, part, n, first in rows:
        before.append((length, part, first - seen.get(length, 0)))
        seen[length] = seen.get(length, 0) + n
    offsets = small_frame(spark, before, "length long, _part long, _zero long")
    ranked = ordered.join(F.broadcast(offsets), ["length", "_part"]).withColumn("rank", F.col("_at") - F.col("_zero"))
    return ranked.drop("_at", "_part", "_zero"), seen


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    ranked, counts = with_ranks(saved(pieces, "tokenised"))
    runs = plan(counts, capacity)
    by_length: dict[int, list] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(run)
    table = {
        length: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(found))) for length, found in by_length.items()
    }
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # bounded by the capacity, see plan()

    def run(batch, state) -> dict:
        lengths = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
        ranks = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            firsts, _, sequences, offsets, per = state[int(length)]
            at = np.searchsorted(firsts, ranks[rows], side="right") - 1
            i = ranks[rows] - firsts[at]
            sequence[rows] = sequences[at] + i // per[at]
            offset[rows] = offsets[at] + (i % per[at]) * length
        same = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if n != "rank"}
        return same | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}

    return map_columns(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), run, PIECES + ", sequence_id long, offset long", lambda: shared.value, rows=8192)


def best_fit(docs: DataFrame, tokens: Tokens, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places; ``sequence_id`` counts from 0."""
    return place(tokenised_pieces(docs, tokens, capacity), capacity)
