"""Type buckets: the coarse types in which schemas are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INTEGER, FLOAT, BOOLEAN = "integer", "float", "boolean"
STRING, DATETIME, TIMEDELTA = "string", "datetime", "timedelta"
UNKNOWN = "unknown"  # only nulls seen: agrees with every bucket

COERCIBLE = (INTEGER, FLOAT, BOOLEAN, DATETIME, STRING)

_BUCKETS: list[tuple[tuple[type[T.DataType], ...], str]] = [
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), INTEGER),
    ((T.FloatType, T.DoubleType), FLOAT),
    ((T.BooleanType,), BOOLEAN),
    ((T.StringType, T.CharType, T.VarcharType), STRING),
    ((T.TimestampType, T.TimestampNTZType), DATETIME),
    ((T.DayTimeIntervalType,), TIMEDELTA),
    ((T.NullType,), UNKNOWN),
]

_CANONICAL: dict[str, T.DataType] = {
    INTEGER: T.LongType(),
    FLOAT: T.DoubleType(),
    BOOLEAN: T.BooleanType(),
    STRING: T.StringType(),
    DATETIME: T.TimestampType(),
    TIMEDELTA: T.DayTimeIntervalType(),
    UNKNOWN: T.StringType(),
}

# raw types met so far: a type name cannot always be parsed back
_RAW: dict[str, T.DataType] = {}

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def bucket_of(data_type: T.DataType, nested_as: str | None = None) -> str:
    """Bucket of a Spark type; types outside the table keep their own name."""
    for classes, bucket in _BUCKETS:
        if isinstance(data_type, classes):
            return bucket
    if nested_as and isinstance(data_type, _NESTED):
        return nested_as
    name = data_type.simpleString()
    _RAW.setdefault(name, data_type)
    return name


def canonical_type(bucket: str) -> T.DataType:
    """The Spark type that stores a bucket; a raw type name stands for itself."""
    if bucket in _CANONICAL:
        return _CANONICAL[bucket]
    return _RAW[bucket] if bucket in _RAW else T.DataType.fromDDL(bucket)


def sql_type(data_type: T.DataType) -> str:
    """The type as SQL text, nested names quoted."""
    if isinstance(data_type, T.StructType):
        fields = ", ".join(f"`{f.name.replace('`', '``')}`: {sql_type(f.dataType)}" for f in data_type.fields)
        return f"struct<{fields}>"
    if isinstance(data_type, T.ArrayType):
        return f"array<{sql_type(data_type.elementType)}>"
    if isinstance(data_type, T.MapType):
        return f"map<{sql_type(data_type.keyType)}, {sql_type(data_type.valueType)}>"
    return data_type.simpleString()


def schema_of(frame: DataFrame, nested_as: str | None = None) -> dict[str, str]:
    """Ordered column -> bucket of a frame."""
    return {f.name: bucket_of(f.dataType, nested_as) for f in frame.schema.fields}


def snapshot(frame: DataFrame, nested_as: str | None = None) -> DataFrame:
    """The schema of a frame as rows (column_name, ordinal, bucket)."""
    rows = [(name, i, bucket) for i, (name, bucket) in enumerate(schema_of(frame, nested_as).items())]
    return frame.sparkSession.createDataFrame(rows, "column_name string, ordinal int, bucket string")
