"""Operators that look at the rows before a row: prefixes, paging, reversal.

Prefixes need no window: the first row that ends one is an aggregate, and what lies
before it is a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compile_condition
from ..functions.access import as_time
from .composing import ERROR, safe
from .ordering import Key, carried, keys, needed, place, sort_columns


def _condition(df: DataFrame, cond: Column | str) -> Column:
    c = compile_condition(cond, df.schema) if isinstance(cond, str) else cond
    return F.coalesce(c, F.lit(False))


def _until(df: DataFrame, stop: Column, order, after: bool) -> DataFrame:
    """Rows before the first one for which ``stop`` holds, or (``after``) from it on."""
    at = place(order)
    cut = df.filter(stop).agg(F.min(at)).scalar()
    return df.filter(at >= cut if after else cut.isNull() | (at < cut))


def take_while(df: DataFrame, cond: Column | str, order) -> DataFrame:
    """Rows before the first for which the condition does not hold. Order columns must tell all rows apart."""
    return _until(df, ~_condition(df, cond), order, after=False)


def take_until(df: DataFrame, cond: Column | str, order) -> DataFrame:
    """Rows before the first for which the condition holds."""
    return _until(df, _condition(df, cond), order, after=False)


def skip_while(df: DataFrame, cond: Column | str, order) -> DataFrame:
    """Rows from the first on for which the condition does not hold."""
    return _until(df, ~_condition(df, cond), order, after=True)


def skip_until(df: DataFrame, cond: Column | str, order) -> DataFrame:
    """Rows from the first on for which the condition holds."""
    return _until(df, _condition(df, cond), order, after=True)


def time_limit(df: DataFrame, time: str, seconds: float, order) -> DataFrame:
    """Rows until one is more than ``seconds`` after the first; rows without a time pass."""
    t = as_time(F.col(f"`{time}`"), df.schema[time].dataType)
    first = df.filter(t.isNotNull()).agg(F.min_by(t, place(order))).scalar()
    late = F.coalesce(t > first + F.make_dt_interval(secs=F.lit(float(seconds))), F.lit(False))
    return _until(df, late, order, after=False)


def sort(df: DataFrame, order, numeric_key: bool = False) -> DataFrame:
    """Rows by the given fields (``-name``: descending); nulls first, NaN before numbers. ``numeric_key``: text counts as 0."""
    cols = []
    for k in needed(order):
        c = F.col(f"`{k.name}`")
        kind = df.schema[k.name].dataType.typeName()
        if numeric_key:
            c = F.coalesce(c.try_cast("double"), F.lit(0.0)) if kind not in ("string", "boolean") else F.lit(0.0)
        elif kind in ("double", "float"):
            cols.append(_nan_first(c, k))
        cols.append(c.desc_nulls_last() if k.desc else c.asc_nulls_first())
    return df.orderBy(*cols)


def _nan_first(c: Column, k: Key) -> Column:
    """Null, then NaN, then numbers (descending: numbers, NaN, null)."""
    rank = F.when(c.isNull(), 0).when(F.isnan(c), 1).otherwise(2)
    return rank.desc() if k.desc else rank.asc()


def limit(df: DataFrame, n: int, order=None) -> DataFrame:
    """The first ``n`` rows (along ``order``, else in the order they come); none for n <= 0."""
    cols = sort_columns(order)
    return (df.orderBy(*cols) if cols else df).limit(max(0, n))


def offset(df: DataFrame, n: int, order=None) -> DataFrame:
    cols = sort_columns(order)
    return (df.orderBy(*cols) if cols else df).offset(max(0, n))


def reverse(df: DataFrame, order) -> DataFrame:
    return df.orderBy(*[k.flipped().col for k in needed(order)])


def limit_safe(df: DataFrame, n: int, order) -> DataFrame:
    """The first ``n`` good rows, and the failed ones before the last of them."""
    return _counted(df, order).filter(F.when(F.col(ERROR).isNull(), F.col("_good") <= n).otherwise(F.col("_good") < max(n, 0))).drop("_good")


def offset_safe(df: DataFrame, n: int, order) -> DataFrame:
    """All but the first ``n`` good rows; failed ones stay."""
    return _counted(df, order).filter(F.col(ERROR).isNotNull() | (F.col("_good") > n)).drop("_good")


def _counted(df: DataFrame, order) -> DataFrame:
    """With the number of good rows up to each row."""
    return carried(safe(df), order, {"_good": ("sum", F.when(F.col(ERROR).isNull(), 1).otherwise(0))})


def distinct(df: DataFrame) -> DataFrame:
    """Rows that differ in a field whose name does not begin with an underscore."""
    names = [c for c in df.columns if not c.startswith("_")]
    return df.dropDuplicates(names) if len(names) < len(df.columns) else df.distinct()


def distinct_by(df: DataFrame, by: list[str], order) -> DataFrame:
    """The first row along ``order`` for each value of ``by``: an aggregate that combines before it shuffles."""
    rest = [c for c in df.columns if c not in by]
    names = [k.name for k in keys(order)]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), place(order)) if names else None
    if first is None:
        needed(order)
    if not rest:
        return df.distinct()
    out = df.groupBy(*by).agg(first.alias("_first"))
    return out.select(*[F.col(f"`{c}`") if c in by else F.col(f"_first.`{c}`").alias(c) for c in df.columns])


def union(*frames: DataFrame, all_rows: bool = False) -> DataFrame:
    """Rows of all frames, fields by name (absent: null); without ``all_rows`` each row once, ``_`` fields not compared."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out if all_rows else distinct(out)
