"""Typed access to fields and conversions between scalar types; what cannot be converted is null."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names a caller may use for the canonical types.
TYPES: dict[object, T.DataType] = {
    int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), dt.datetime: T.TimestampNTZType(),
    "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType(), "time": T.TimestampNTZType(),
}

#: Text layouts a time may have.
TIME_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")

_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def data_type(kind) -> T.DataType:
    return kind if isinstance(kind, T.DataType) else TYPES[kind]


def is_time(t: T.DataType) -> bool:
    return isinstance(t, _TIMES)


def convert(col: Column, source: T.DataType, kind) -> Column:
    """``col`` of type ``source`` as ``kind``: numbers from text that is one, 1/0 from bool, bool as "not zero"
    or "not empty", times from text in one of ``TIME_LAYOUTS`` or from unix seconds."""
    to = data_type(kind)
    none = F.lit(None).cast(to)
    if source == to:
        return col
    if isinstance(to, T.LongType):
        if isinstance(source, T.StringType):
            return F.when(col.rlike(r"^[+-]?\d+$"), col.try_cast(to))
        return none if is_time(source) else col.try_cast(to)
    if isinstance(to, T.DoubleType):
        return none if isinstance(source, T.BooleanType) or is_time(source) else col.try_cast(to)
    if isinstance(to, T.BooleanType):
        if isinstance(source, T.StringType):
            return col != ""
        return col != 0 if isinstance(source, T.NumericType) else none
    if is_time(to):
        return as_time(col, source)
    if isinstance(to, T.StringType):
        return F.to_json(col) if isinstance(source, (T.ArrayType, T.StructType, T.MapType)) else col.cast(to)
    return col.try_cast(to)


def as_time(col: Column, source: T.DataType) -> Column:
    """A time without zone (UTC) from a time, text, or unix seconds."""
    ntz = T.TimestampNTZType()
    if isinstance(source, T.TimestampNTZType):
        return col
    if is_time(source):
        return col.cast(ntz)
    if isinstance(source, T.StringType):
        s = F.trim(col)
        zoned = F.to_utc_timestamp(F.try_to_timestamp(s, F.lit(TIME_LAYOUTS[0])), F.current_timezone()).cast(ntz)
        plain = [F.try_to_timestamp(s, F.lit(layout)).cast(ntz) for layout in TIME_LAYOUTS[1:]]
        return F.coalesce(zoned, *plain)
    if isinstance(source, T.IntegralType):
        return F.to_utc_timestamp(F.timestamp_seconds(col), F.current_timezone()).cast(ntz)
    if isinstance(source, T.NumericType):
        return F.to_utc_timestamp(F.timestamp_micros((col * 1_000_000).cast("long")), F.current_timezone()).cast(ntz)
    return F.lit(None).cast(ntz)


def get(df: DataFrame, name: str, kind) -> Column:
    """Field ``name`` of ``df`` as ``kind``; null where it is absent or cannot be converted."""
    if name not in df.columns:
        return F.lit(None).cast(data_type(kind))
    return convert(F.col(f"`{name}`"), df.schema[name].dataType, kind)


def get_or(df: DataFrame, name: str, default) -> Column:
    """Field ``name`` as the type of ``default``, or ``default`` where that gives nothing."""
    kind = data_type(type(default))
    return F.coalesce(get(df, name, kind), F.lit(default).cast(kind))


def has(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").isNotNull() if name in df.columns else F.lit(False)


def set_field(df: DataFrame, name: str, value, kind=None) -> DataFrame:
    """``df`` with a field set to a constant or a column; sequences become arrays, dicts structs."""
    col = literal(value)
    return df.withColumn(name, col if kind is None else col.cast(data_type(kind)))


def literal(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, dict):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    if isinstance(value, bool) or not isinstance(value, int):
        return F.lit(value)
    return F.lit(value).cast("long")


def delete(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def parse_json(col: Column) -> Column:
    """Text to VARIANT; null where it is no JSON."""
    return F.try_parse_json(col)


def json_valid(col: Column) -> Column:
    return F.coalesce(F.try_parse_json(col).isNotNull(), F.lit(False))


def json_pretty(col: Column) -> Column:
    """JSON text indented by two spaces; text that is no JSON as it is. No column function indents a value of any type."""

    @F.pandas_udf("string")
    def indented(texts: pd.Series) -> pd.Series:
        return texts.map(_indent, na_action="ignore")

    return indented(col)


def _indent(text: str) -> str:
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return text


#: What a canonical record may hold.
_CANONICAL = (T.LongType, T.DoubleType, T.StringType, T.BooleanType, T.TimestampType, T.TimestampNTZType)


def invalid_fields(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    """Fields whose type is none of the canonical ones (whole numbers and floats in 64 bits, text, bool, time, records of those, sequences)."""

    def fine(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return all(fine(f.dataType) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return fine(t.elementType) or isinstance(t.elementType, T.NumericType)
        return isinstance(t, _CANONICAL)

    return [f.name for f in df.schema.fields if (names is None or f.name in names) and not fine(f.dataType)]


def guess_literal(text: str):
    """A typed value from the text of a command line: bool, whole number, number, time, else text."""
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    for layout in ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d"):
        try:
            at = dt.datetime.strptime(text, layout)
        except ValueError:
            continue
        return at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    return text
