"""Groups and their aggregates. A group is not collected: grouping and aggregating are one step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compile_expression
from ..functions.access import convert, data_type
from .ordering import place

#: What an aggregate over nothing gives, by type.
_ZERO = {T.LongType(): 0, T.DoubleType(): 0.0, T.StringType(): "", T.BooleanType(): False}


@dataclass(frozen=True)
class Aggregate:
    """``make(frame)`` gives the aggregate column; ``sql_nulls`` leaves null where there was no value."""

    make: Callable[[DataFrame, bool], Column]


def _values(df: DataFrame, name: str, kind) -> Column:
    if name not in df.columns:
        return F.lit(None).cast(data_type(kind))
    return convert(F.col(f"`{name}`"), df.schema[name].dataType, kind)


def _filled(c: Column, kind, sql_nulls: bool) -> Column:
    zero = _ZERO.get(data_type(kind))
    return c if sql_nulls or zero is None else F.coalesce(c, F.lit(zero).cast(data_type(kind)))


def count() -> Aggregate:
    return Aggregate(lambda df, nulls: F.count(F.lit(1)))


def sum_(name: str) -> Aggregate:
    """Sum as a float of all values that are numbers; 0.0 when none is."""
    return Aggregate(lambda df, nulls: _filled(F.sum(_values(df, name, float)), float, nulls))


def avg(name: str) -> Aggregate:
    return Aggregate(lambda df, nulls: _filled(F.avg(_values(df, name, float)), float, nulls))


def min_(name: str, kind=float) -> Aggregate:
    return Aggregate(lambda df, nulls: _filled(F.min(_values(df, name, kind)), kind, nulls))


def max_(name: str, kind=float) -> Aggregate:
    return Aggregate(lambda df, nulls: _filled(F.max(_values(df, name, kind)), kind, nulls))


def first(name: str, order, kind=None) -> Aggregate:
    """The first value along ``order`` that is not null."""
    return _edge(name, order, kind, F.min_by)


def last(name: str, order, kind=None) -> Aggregate:
    return _edge(name, order, kind, F.max_by)


def _edge(name: str, order, kind, by) -> Aggregate:
    def make(df: DataFrame, nulls: bool) -> Column:
        k = kind if kind is not None else (df.schema[name].dataType if name in df.columns else T.StringType())
        v = _values(df, name, k)
        return _filled(by(v, F.when(v.isNotNull(), place(order))), k, nulls)

    return Aggregate(make)


def collect(name: str, order=None) -> Aggregate:
    """All values as an array, along ``order`` where one is given."""

    def make(df: DataFrame, nulls: bool) -> Column:
        c = F.col(f"`{name}`")
        if order is None:
            return F.collect_list(c)
        rows = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(place(order).alias("o"), c.alias("v")))))
        return F.transform(rows, lambda x: x["v"])

    return Aggregate(make)


def column(c: Column) -> Aggregate:
    """Any aggregate column."""
    return Aggregate(lambda df, nulls: c)


@dataclass(frozen=True)
class Grouped:
    """Rows by key, waiting to be aggregated."""

    frame: DataFrame
    by: tuple[str, ...]

    def aggregate(self, sql_nulls: bool = False, **aggregates: Aggregate | Column) -> DataFrame:
        """One row per group with the keys and the named aggregates."""
        made = [(a.make(self.frame, sql_nulls) if isinstance(a, Aggregate) else a).alias(n) for n, a in aggregates.items()]
        return self._grouped().agg(*made) if made else self.keys()

    def keys(self) -> DataFrame:
        return self.frame.select(*[F.col(f"`{b}`") for b in self.by]).distinct()

    def sequence(self, name: str = "_group") -> DataFrame:
        """One row per group with its rows as an array of records; for groups that fit a row."""
        return self._grouped().agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in self.frame.columns])).alias(name))

    def apply(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
        """A Python function over each group's rows; for what aggregates cannot express."""
        return self._grouped().applyInPandas(fn, schema)

    def _grouped(self) -> GroupedData:
        return self.frame.groupBy(*[F.col(f"`{b}`") for b in self.by])


def group_by_fields(df: DataFrame, *names: str) -> Grouped:
    """Rows by typed values of fields; an absent field is a null key. Records and arrays cannot be keys."""
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast("string"))
        elif isinstance(df.schema[n].dataType, (T.ArrayType, T.StructType, T.MapType)):
            raise ValueError(f"{n} is a record or sequence and cannot be a key")
    return Grouped(df, names)


def group_by(df: DataFrame, name: str, key: Column | str) -> Grouped:
    """Rows by a computed key, called ``name``."""
    c = compile_expression(key, df.schema) if isinstance(key, str) else key
    return Grouped(df.withColumn(name, c), (name,))


def aggregate_sequence(df: DataFrame, sequence: str, **aggregates: Aggregate) -> DataFrame:
    """Aggregates over an array of records in place of it; without that field rows pass unchanged."""
    if sequence not in df.columns:
        return df
    rest = [c for c in df.columns if c != sequence]
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    inner = rows.select("_row", *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(rest)], F.inline_outer(F.col(f"`{sequence}`")))
    made = []
    for n, a in aggregates.items():
        made.append(a.make(inner, False).alias(n))
    out = inner.groupBy("_row", *[f"_k{i}" for i in range(len(rest))]).agg(*made)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(rest)], *[F.col(f"`{n}`") for n in aggregates])
