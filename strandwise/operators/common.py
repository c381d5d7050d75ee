"""What the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A side is broadcast only if its measured size stays below this.
BROADCAST_BYTES = 64 << 20


def _width(value: Column, kind: DataType) -> Column:
    """Bytes that a value takes in memory, at most about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 24
    if isinstance(kind, StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(24).cast("long"), lambda a, x: a + _width(x, kind.elementType).cast("long")), F.lit(24))
    if isinstance(kind, MapType):
        return _width(F.map_keys(value), ArrayType(kind.keyType)) + _width(F.map_values(value), ArrayType(kind.valueType))
    return F.lit(16)


def small_side(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it, else unmarked (a shuffled join)."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
