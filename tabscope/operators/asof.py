"""As-of join: for each left row the latest right row at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.functions.names import col
from tabscope.operators.scan import PART_ROWS, running


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    time: str,
    values: list[str],
    strict: bool = False,
    slice_seconds: float | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """All left rows with ``values`` of the latest right row of the same key.

    ``strict`` takes earlier rows only, otherwise a right row at the same time
    counts. Both sides must share the names of ``key`` and ``time``; no right row
    gives nulls.

    Both sides are one sequence per key in which the last right row is carried on, a
    segmented scan (``scan.py``): a key of more than ``part_rows`` rows is cut into parts
    of about that many, wherever its rows lie in time, a burst of one instant included.
    ``slice_seconds`` is accepted from earlier versions and has no effect.

    Right rows of equal key and time are one row before the scan, the greatest by
    ``values``. Left rows without key or time have no match and pass round it.
    """
    known = col(key).isNotNull() & col(time).isNotNull()
    matchless = left.where(~known).select("*", *[F.lit(None).cast(right.schema[v].dataType).alias(f"asof_{v}") for v in values])
    left, right = left.where(known), right.where(known)
    payload = F.struct(col(time).alias("_time"), *[col(v) for v in values])
    first, second = (0, 1) if strict else (1, 0)

    lefts = left.select(col(key).alias("_key"), col(time).alias("_at"), F.lit(first).alias("_order"), F.struct(*map(col, left.columns)).alias("_row"))
    rights = right.groupBy(col(key).alias("_key"), col(time).alias("_at")).agg(F.max(payload).alias("_right"))
    both = lefts.unionByName(rights.withColumn("_order", F.lit(second)), allowMissingColumns=True)
    # the side in the highest bit, then a number per row
    number = F.col("_order") * F.lit(2**62) + F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 2)
    carried = running(both, ["_key"], ["_at", "_order"], {"_found": ("last", "_right")}, part_rows, number)
    matched = carried.where(F.col("_row").isNotNull())
    return matched.select("_row.*", *[F.col("_found")[v].alias(f"asof_{v}") for v in values]).unionAll(matchless)
