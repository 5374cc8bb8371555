"""Records of CSV files whose quoted values hold line breaks, read by many tasks.

Lines are read split by split. A line break lies inside a quoted value where an odd
number of quotes stands before it in the file, so each split gives the parity of its
quotes, an exclusive-or over the splits before says whether a split begins inside quotes,
and every task then joins the lines of its own records. What a record leaves in the next
splits is put together afterwards, at most two pieces for each split. Spark's CSV parser
reads the records.

Quotes that stand inside unquoted values make parity meaningless; records show them, and
the caller then falls back to a reader that cannot split files.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PIECES = "text string, file long, block long, whole boolean, opens boolean, header boolean"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): lines in the order of their split; a carriage return stays at the end."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def splits_inside_quotes(lines: DataFrame) -> set[tuple[int, int]]:
    """The splits that begin inside a quoted value; one row per split comes to the driver."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parity: dict[int, list] = defaultdict(list)
    for r in lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd")).collect():
        parity[r["file"]].append((r["block"], r["odd"]))
    found = set()
    for file, blocks in parity.items():
        inside = 0
        for block, odd in sorted(blocks):
            if inside:
                found.add((file, block))
            inside ^= odd
    return found


class _Split:
    """The lines of one split as they come by; ``pending`` is the record that is not ended."""

    def __init__(self, file: int, block: int, inside: bool):
        self.file, self.block, self.parity = file, block, int(inside)
        self.pending: list[str] = []
        self.opens = not inside  # whether the pending record begins in this split
        self.first = True

    def piece(self, whole: bool) -> tuple:
        header = self.block == 0 and self.first and self.opens
        self.first = False
        return "\n".join(self.pending), self.file, self.block, whole, self.opens, header

    def feed(self, values: pa.StringArray):
        """(records of one line, other pieces) that these lines complete."""
        quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        before = (self.parity + np.cumsum(quotes) - quotes) % 2
        starts = np.flatnonzero(before == 0)
        self.parity = int((self.parity + quotes.sum()) % 2)
        if not len(starts):
            self.pending += values.to_pylist()
            return values[:0], []
        self.pending += values[: starts[0]].to_pylist()
        pieces = []
        if self.pending:
            pieces.append(self.piece(self.opens))
        self.opens = True
        ends = np.append(starts[1:], len(values))
        last = int(starts[-1])
        alone = starts[:-1][ends[:-1] - starts[:-1] == 1]
        if self.first and len(starts) > 1:  # a header goes its own way
            self.pending = values[: ends[0]].to_pylist()
            pieces.append(self.piece(True))
            alone, starts, ends = alone[alone > 0], starts[1:], ends[1:]
        for a, b in zip(starts[:-1], ends[:-1]):
            if b - a > 1:
                self.pending = values[a:b].to_pylist()
                pieces.append(self.piece(True))
        self.pending = values[last:].to_pylist()
        return values.take(pa.array(alone)), pieces

    def end(self) -> list[tuple]:
        """The last record: whole, or a piece that goes on in the next split."""
        return [self.piece(self.opens and not self.parity)] if self.pending else []


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, header): every record of the files as one text; ``header`` marks the first of a file."""
    lines = read_lines(spark, path)
    inside = splits_inside_quotes(lines)
    target = to_arrow_schema(StructType.fromDDL(PIECES))

    def out(split: _Split, alone, pieces):
        n = len(alone)
        if n:
            constant = (split.file, split.block, True, True, False)
            yield pa.RecordBatch.from_arrays(
                [alone, *[pa.array([v] * n, f.type) for v, f in zip(constant, list(target)[1:])]], schema=target
            )
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces), target)], schema=target)

    def run(batches):
        split = None
        for batch in batches:
            values, files, blocks = batch.columns[0], *(c.to_numpy() for c in batch.columns[1:])
            edges = [0, *(np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                place = int(files[a]), int(blocks[a])
                if split is None or (split.file, split.block) != place:
                    if split is not None:
                        yield from out(split, values[:0], split.end())
                    split = _Split(*place, place in inside)
                yield from out(split, *split.feed(values.slice(a, b - a)))
        if split is not None:
            yield from out(split, pa.array([], pa.string()), split.end())

    pieces = lines.mapInArrow(run, PIECES)
    # a record that runs over splits: the piece that opens it and those up to the next one that opens
    broken = pieces.where(~F.col("whole"))
    order = W.partitionBy("file").orderBy("block", "opens")
    chained = broken.withColumn("chain", F.sum(F.col("opens").cast("int")).over(order))
    joined = chained.groupBy("file", "chain").agg(
        F.sort_array(F.collect_list(F.struct("block", "opens", "text"))).alias("all"), F.max("header").alias("header")
    )
    joined = joined.select(F.array_join(F.transform("all", lambda p: p["text"]), "\n").alias("record"), "header")
    every = pieces.where("whole").select(F.col("text").alias("record"), "header").unionByName(joined)
    record = F.col("record")
    return every.select(F.when(record.endswith("\r"), F.left(record, F.length(record) - 1)).otherwise(record).alias("record"), "header")


def fields_in(record: Column, sep: str) -> Column:
    """The number of fields of a record."""
    return F.size(F.split(F.regexp_replace(F.replace(record, F.lit('""'), F.lit("")), '"[^"]*"', ""), f"[{sep}]"))


def has_stray_quotes(record: Column, sep: str) -> Column:
    """Whether quotes stand elsewhere than around whole fields."""
    pairs = F.replace(record, F.lit('""'), F.lit(""))
    return F.regexp_replace(pairs, f'(^|[{sep}])"[^"]*"(?=[{sep}]|$)', "$1").contains('"')


def parse_records(records: DataFrame, names: list[str], options: dict[str, str]) -> DataFrame:
    """Text columns ``names`` of records without their headers, by Spark's CSV parser."""
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = records.where(~F.col("header") & (F.trim("record") != "")).select(F.from_csv("record", schema, options).alias("r"))
    return rows.select([F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
