"""Type names of stage plans and their Spark types.

Unsigned integers widen to the next signed type (64 bits to decimal(20, 0));
nanosecond times are cut to microseconds; dictionary and run-end encodings stand
for their values' type.
"""

from __future__ import annotations

from pyspark.sql import types as T

NAMED: dict[str, T.DataType] = {
    "null": T.NullType(),
    "boolean": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "utf8": T.StringType(),
    "largeutf8": T.StringType(),
    "binary": T.BinaryType(),
    "largebinary": T.BinaryType(),
    "date32": T.DateType(),
    "date64": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "timestamp_tz": T.TimestampType(),
    "duration": T.DayTimeIntervalType(),
    "interval_month": T.YearMonthIntervalType(),
    "time64": T.TimeType(6),
    "variant": T.VariantType(),
}
_WIDTH = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]


def spark_type(name: str | T.DataType) -> T.DataType:
    """A Spark type from one of NAMED, ``list<t>``, ``map<k,v>``, ``struct<a:t,..>`` or any Spark DDL type."""
    if isinstance(name, T.DataType):
        return name
    text = name.strip()
    head, _, rest = text.partition("<")
    if rest and head.lower() in ("list", "largelist", "fixedsizelist", "dictionary", "runend"):
        inner = spark_type(rest[:-1])
        return T.ArrayType(inner) if "list" in head.lower() else inner
    if rest and head.lower() == "map":
        key, value = _split(rest[:-1])
        return T.MapType(spark_type(key), spark_type(value))
    if rest and head.lower() == "struct":
        return T.StructType([T.StructField(f.partition(":")[0].strip(), spark_type(f.partition(":")[2])) for f in _split(rest[:-1])])
    if text.lower() in NAMED:
        return NAMED[text.lower()]
    return T.DataType.fromDDL(text)


def _split(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def aggregatable(kind: T.DataType) -> bool:
    """Numbers and times can be summed up or averaged over; text, truth values and nested types can't."""
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType))


def comparable(a: T.DataType, b: T.DataType) -> bool:
    if isinstance(a, T.NullType) or isinstance(b, T.NullType) or a == b:
        return True
    if is_numeric(a) and is_numeric(b):
        return True
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return isinstance(a, times) and isinstance(b, times)


def promoted(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type of arithmetic on two numbers, as Spark's ANSI coercion has it."""
    if not (is_numeric(a) and is_numeric(b)):
        raise TypeError(f"no common numeric type of {a.simpleString()} and {b.simpleString()}")
    for kind in (T.DoubleType, T.FloatType):
        if isinstance(a, kind) or isinstance(b, kind):
            other = b if isinstance(a, kind) else a
            return T.DoubleType() if kind is T.FloatType and not isinstance(other, T.FloatType) else kind()
    if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
        return a if isinstance(a, T.DecimalType) else b
    return _WIDTH[max(_WIDTH.index(type(a)), _WIDTH.index(type(b)))]()
