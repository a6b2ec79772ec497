"""Descriptors as Arrow fields and as Spark types, and back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

from tessera.types.core import FieldType, fields_of, is_list

_KEYS = ("semantic", "pii_class", "description")


def to_arrow_field(name: str, t: FieldType) -> pa.Field:
    meta = {f"tessera.{k}": str(v) for k in _KEYS if (v := getattr(t, k))}
    return pa.field(name, t.arrow_type, nullable=t.is_nullable, metadata=meta or None)


def from_arrow_field(f: pa.Field) -> FieldType:
    meta = {k.decode(): v.decode() for k, v in (f.metadata or {}).items()}
    return FieldType(f.type, **{k: meta.get(f"tessera.{k}") for k in _KEYS})


_SPARK = [
    (pa.types.is_null, T.NullType()), (pa.types.is_boolean, T.BooleanType()),
    (pa.types.is_int8, T.ByteType()), (pa.types.is_int16, T.ShortType()), (pa.types.is_int32, T.IntegerType()), (pa.types.is_int64, T.LongType()),
    (pa.types.is_uint8, T.ShortType()), (pa.types.is_uint16, T.IntegerType()), (pa.types.is_uint32, T.LongType()), (pa.types.is_uint64, T.DecimalType(20, 0)),
    (pa.types.is_float16, T.FloatType()), (pa.types.is_float32, T.FloatType()), (pa.types.is_float64, T.DoubleType()),
    (pa.types.is_string, T.StringType()), (pa.types.is_large_string, T.StringType()), (pa.types.is_time, T.StringType()),
    (pa.types.is_binary, T.BinaryType()), (pa.types.is_large_binary, T.BinaryType()), (pa.types.is_date, T.DateType()), (pa.types.is_duration, T.DayTimeIntervalType()),
]


def to_spark(t: pa.DataType) -> T.DataType:
    """The Spark type of an Arrow type; unsigned integers become the next wider signed type."""
    for test, spark in _SPARK:
        if test(t):
            return spark
    if pa.types.is_timestamp(t):
        return T.TimestampType() if t.tz else T.TimestampNTZType()
    if pa.types.is_decimal(t):
        return T.DecimalType(t.precision, t.scale)
    if is_list(t):
        return T.ArrayType(to_spark(t.value_type))
    if pa.types.is_struct(t):
        return T.StructType([T.StructField(f.name, to_spark(f.type)) for f in fields_of(t)])
    if pa.types.is_map(t):
        return T.MapType(to_spark(t.key_type), to_spark(t.item_type))
    return T.StringType()


_ARROW = [
    (T.NullType, pa.null()), (T.BooleanType, pa.bool_()), (T.ByteType, pa.int8()), (T.ShortType, pa.int16()), (T.IntegerType, pa.int32()), (T.LongType, pa.int64()),
    (T.FloatType, pa.float32()), (T.DoubleType, pa.float64()), (T.BinaryType, pa.binary()), (T.DateType, pa.date32()),
    (T.TimestampNTZType, pa.timestamp("us")), (T.TimestampType, pa.timestamp("us", "UTC")), (T.DayTimeIntervalType, pa.duration("us")),
]


def from_spark(t: T.DataType) -> pa.DataType:
    for kind, arrow in _ARROW:
        if type(t) is kind:
            return arrow
    if isinstance(t, T.DecimalType):
        return pa.decimal128(t.precision, t.scale)
    if isinstance(t, T.ArrayType):
        return pa.list_(from_spark(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, from_spark(f.dataType)) for f in t.fields])
    if isinstance(t, T.MapType):
        return pa.map_(from_spark(t.keyType), from_spark(t.valueType))
    return pa.string()
