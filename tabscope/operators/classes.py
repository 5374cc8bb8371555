"""The four column classes that decide which statistics a column gets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.functions.names import col

NUMERIC, BOOLEAN, TEMPORAL, OTHER = "numeric", "boolean", "temporal", "other"

INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING_TYPES = (T.FloatType, T.DoubleType)
TEMPORAL_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass(frozen=True)
class ColumnInfo:
    ordinal: int
    name: str
    data_type: T.DataType

    @property
    def dtype(self) -> str:
        return self.data_type.simpleString()

    @property
    def kind(self) -> str:
        if isinstance(self.data_type, T.BooleanType):
            return BOOLEAN
        if isinstance(self.data_type, INTEGRAL_TYPES + FLOATING_TYPES + (T.DecimalType,)):
            return NUMERIC
        return TEMPORAL if isinstance(self.data_type, TEMPORAL_TYPES) else OTHER

    @property
    def value(self) -> Column:
        """The column with NaN as null, since NaN counts as missing."""
        c = col(self.name)
        return F.when(~F.isnan(c), c) if isinstance(self.data_type, FLOATING_TYPES) else c

    @property
    def is_missing(self) -> Column:
        c = col(self.name)
        return c.isNull() | F.isnan(c) if isinstance(self.data_type, FLOATING_TYPES) else c.isNull()

    @property
    def text(self) -> Column:
        """The value as text; nested values as JSON, binary as hex."""
        c = col(self.name)
        if isinstance(self.data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return F.to_json(c)
        if isinstance(self.data_type, T.BinaryType):
            return F.hex(c)
        return c.cast("string")

    @property
    def key_family(self) -> str:
        """The Spark type in which values of this column are grouped exactly."""
        if isinstance(self.data_type, INTEGRAL_TYPES + (T.BooleanType, T.TimestampType)):
            return "bigint"
        if isinstance(self.data_type, FLOATING_TYPES):
            return "double"
        return "timestamp_ntz" if self.kind == TEMPORAL else "string"

    @property
    def key(self) -> Column:
        if isinstance(self.data_type, T.TimestampType):
            return F.unix_micros(col(self.name))
        if isinstance(self.data_type, T.BooleanType):
            return col(self.name).cast("int").cast("bigint")
        if self.key_family == "string":
            return self.text
        return self.value.cast(self.key_family)


def column_infos(df: DataFrame) -> list[ColumnInfo]:
    return [ColumnInfo(i, f.name, f.dataType) for i, f in enumerate(df.schema.fields)]


def batches(infos: list[ColumnInfo], size: int) -> list[list[ColumnInfo]]:
    return [infos[i : i + size] for i in range(0, len(infos), size)]


def rows_per_column(agg: DataFrame, records: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct in ``records``."""
    return agg.select(F.inline(F.array(*records)))
