"""Shared pieces of the corpus operators: words, scratch tables and Arrow maps."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from tabscope.session import scratch_path

#: Fixed value: a word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: The same separators for ``str.split``-like work in Python; str.split() would also
#: split at other Unicode spaces.
SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Row numbers of a bitmap (fixed by Spark) as a power of two, and bitmaps of one broadcast:
#: at most 4 KB each, 32 MB in all.
BITMAP_POWER = 15
BITMAPS = 8_192


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again.

    The written table cuts the lineage: a lost executor costs no more than the
    tasks that ran on it, and later steps do not compute ``df`` again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_among(table: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of ``table`` whose ``_row`` is in ``numbers`` (_row), without shuffling them.

    ``_row`` is monotonically_increasing_id of the table, which is written. The numbers,
    eight bytes each, are shuffled and become bitmaps. Spans of row numbers with about
    BITMAPS bitmaps each are read one by one, each with a broadcast of its own bitmaps, so
    a broadcast does not grow with the table.
    """
    place = F.col("_row").bitwiseAND(2**BITMAP_POWER - 1)
    bitmaps = saved(
        # dealt by bitmap first: partial bitmaps of every task would be many times the numbers
        numbers.select(F.shiftright("_row", BITMAP_POWER).alias("_bitmap"), place.alias("_place"))
        .repartition("_bitmap")
        .groupBy("_bitmap")
        .agg(F.bitmap_construct_agg("_place").alias("_bits"), F.max("_place").alias("_last"))
        .select("_bitmap", F.expr("substring(_bits, 1, int(_last div 8) + 1)").alias("_bits")),
        "bitmaps",
    )
    spans = max(1, math.ceil(bitmaps.count() / BITMAPS))
    cuts = []
    if spans > 1:
        shares = [k / spans for k in range(1, spans)]
        cuts = sorted(set(bitmaps.agg(F.percentile_approx("_bitmap", shares, 100 * spans)).first()[0]))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    found = (F.shiftright("_row", BITMAP_POWER) == F.col("_bitmap")) & (F.getbit(byte.cast("long"), place.bitwiseAND(7).cast("int")) == 1)
    parts = []
    for low, high in itertools.pairwise([None, *cuts, None]):
        rows, bits = table, bitmaps
        if low is not None:
            rows, bits = rows.where(F.col("_row") >= (low + 1) << BITMAP_POWER), bits.where(F.col("_bitmap") > low)
        if high is not None:
            rows, bits = rows.where(F.col("_row") < (high + 1) << BITMAP_POWER), bits.where(F.col("_bitmap") <= high)
        parts.append(rows.join(F.broadcast(bits), found, "left_semi"))
    return reduce(DataFrame.union, parts)


def map_columns(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], Iterator[dict]],
    schema: str | StructType,
    setup: Callable[[], object] | None = None,
    rows: int = 512,
) -> DataFrame:
    """``function(batch, state)`` over slices of at most ``rows`` rows of each task.

    It returns a dict of columns. ``state`` is what ``setup`` made once per task.
    Small slices bound the memory of a task whatever the Arrow batch size is.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches):
        state = setup() if setup is not None else None
        batch = columns = None
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                columns = function(batch.slice(start, rows), state)
                yield pa.RecordBatch.from_arrays(
                    [
                        c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
                        for f, c in ((f, columns[f.name]) for f in target)
                    ],
                    schema=target,
                )
        # workers stay for later stages, and Arrow's pool would keep the batches' memory meanwhile
        batch = columns = None
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def doc_with_text(docs: DataFrame, text: str) -> tuple[list[Column], str]:
    """``_doc`` with the columns of ``docs``, and the name of the text in ``text_column``.

    A string is read from ``_doc``; anything else is cast and sent beside it as ``_text``.
    Batches of texts lie outside the heap, in Spark's Arrow vectors and once more in its
    buffer to the worker, so each text goes there once only.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    if text in docs.columns and text not in ("_doc", "_id", "_row") and isinstance(docs.schema[text].dataType, StringType):
        return [own], text
    return [own, F.col(f"`{text}`").cast("string").alias("_text")], "_text"


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column of a batch, or else that field of its ``_doc``."""
    names = batch.schema.names
    return batch.column(names.index(name)) if name in names else batch.column(names.index("_doc")).field(name)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch as Python strings, null as the empty text."""
    return [t or "" for t in text_column(batch, name).to_pylist()]
