"""Operators on single rows: projection, update, filters, flattening, renaming, and their error-aware twins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compile_condition, compile_expression
from ..functions.access import guess_literal, is_time
from .composing import ERROR, safe

Condition = Column | str


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def condition(df: DataFrame, cond: Condition) -> Column:
    """A Column as it is, or a text in the expression language."""
    return compile_condition(cond, df.schema) if isinstance(cond, str) else cond


def value(df: DataFrame, v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# projection


def select(df: DataFrame, **exprs: Column | str) -> DataFrame:
    """Only the given columns: a Column, or a text in the expression language."""
    return df.select(*[(compile_expression(e, df.schema) if isinstance(e, str) else e).alias(n) for n, e in exprs.items()])


def select_rows(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | T.StructType) -> DataFrame:
    """Rows by a Python function over batches; for what columns cannot express."""
    return df.mapInPandas(fn, schema)


def select_many(df: DataFrame, array: Column | str, name: str) -> DataFrame:
    """One row for each element of an array column, in place of it; none for an empty or null one."""
    c = compile_expression(array, df.schema) if isinstance(array, str) else array
    return df.select(*[col(x) for x in df.columns if x != name], F.explode(c).alias(name))


def include(df: DataFrame, *names: str) -> DataFrame:
    """The named fields, in that order; unknown names are passed over."""
    return df.select(*[col(n) for n in dict.fromkeys(names) if n in df.columns])


def exclude(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def rename(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Old to new names, one after the other; a field already called so is replaced, an absent one is passed over."""
    now = {c: c for c in df.columns}  # present name -> column of df
    for old, new in pairs:
        if old in now and old != new:
            now = {(new if k == old else k): v for k, v in now.items() if k != new}
    return df.select(*[col(v).alias(k) for k, v in now.items()])


def update(df: DataFrame, **values) -> DataFrame:
    """Fields set at once: every value is computed from the row as it was. Values are Columns or constants."""
    return df.withColumns({n: value(df, v) for n, v in values.items()})


@dataclass
class Clause:
    """One IF of an update or OR-branch of a filter: conditions that must all hold, and what is set then.

    ``matches`` are ``(field, operator, literal)``; ``exprs`` conditions in the
    expression language; ``sets`` literals and ``set_exprs`` expressions by field.
    """

    matches: Sequence[tuple[str, str, object]] = ()
    exprs: Sequence[str] = ()
    sets: Mapping[str, object] = field(default_factory=dict)
    set_exprs: Mapping[str, str] = field(default_factory=dict)

    def holds(self, df: DataFrame) -> Column:
        out = F.lit(True)
        for name, op, literal in self.matches:
            out = out & match(df, name, op, literal)
        for e in self.exprs:
            out = out & compile_condition(e, df.schema)
        return out


def update_clauses(df: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """The first clause that holds sets its fields; one without conditions is an ELSE. All see the row as it was."""
    names = list(dict.fromkeys(n for c in clauses for n in (*c.sets, *c.set_exprs)))
    made: dict[str, list[Column | None]] = {n: [] for n in names}
    holds = []
    for c in clauses:
        holds.append(c.holds(df))
        for n in names:
            if n in c.set_exprs:
                made[n].append(compile_expression(c.set_exprs[n], df.schema))
            else:
                made[n].append(F.lit(_widened(c.sets[n])) if n in c.sets else None)
    out = {}
    for n in names:
        old = col(n) if n in df.columns else F.lit(None)
        chosen = None
        for h, v in zip(holds, made[n], strict=True):
            v = old if v is None else v
            chosen = F.when(h, v) if chosen is None else chosen.when(h, v)
        out[n] = chosen.otherwise(old)
    return df.withColumns(out)


def _widened(v):
    return F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else v


# filters


def where(df: DataFrame, cond: Condition) -> DataFrame:
    return df.filter(condition(df, cond))


def where_clauses(df: DataFrame, clauses: Sequence[Clause]) -> DataFrame:
    """Rows for which one of the clauses holds."""
    out = F.lit(False)
    for c in clauses:
        out = out | c.holds(df)
    return df.filter(out)


def match(df: DataFrame, name: str, op: str, literal) -> Column:
    """A comparison as the type of the field has it; a field that is absent or null matches nothing, not even ``ne``."""
    if op not in MATCHES:
        raise ValueError(f"unknown operator {op}; there are {', '.join(MATCHES)}")
    if name not in df.columns:
        return F.lit(False)
    c, kind = col(name), df.schema[name].dataType
    if op in ("contains", "startswith", "endswith"):
        return {"contains": c.contains, "startswith": c.startswith, "endswith": c.endswith}[op](str(literal)) if isinstance(kind, T.StringType) else F.lit(False)
    if op in ("pattern", "regexp", "regex"):
        return c.cast("string").rlike(str(literal)) if _is_pattern(df, str(literal)) else F.lit(False)
    lit = guess_literal(literal) if isinstance(literal, str) and not isinstance(kind, T.StringType) else literal
    if isinstance(kind, T.NumericType):
        comparable = isinstance(lit, (int, float)) and not isinstance(lit, bool)
    elif isinstance(kind, T.StringType):
        comparable, lit = True, str(lit)
    elif isinstance(kind, T.BooleanType):
        comparable = isinstance(lit, bool) and op in ("eq", "ne")
    else:
        comparable = is_time(kind) and not isinstance(lit, (int, float, str))
    if not comparable:  # other kinds are only compared for equality, as text
        return {"eq": c.cast("string") == str(literal), "ne": c.cast("string") != str(literal)}.get(op, F.lit(False))
    v = F.lit(lit)
    return {"eq": c == v, "ne": c != v, "gt": c > v, "lt": c < v, "ge": c >= v, "le": c <= v}[op]


def _is_pattern(df: DataFrame, text: str) -> bool:
    """Whether the engine's own regular expressions take ``text``; one they do not take matches nothing."""
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(text)
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


MATCHES = ("eq", "ne", "gt", "lt", "ge", "le", "contains", "startswith", "endswith", "pattern", "regexp", "regex")


# twins that carry errors


def select_safe(df: DataFrame, error: Column | None = None, **exprs: Column | str) -> DataFrame:
    """``update`` on an error frame: where ``error`` gives a message the row fails; failed rows pass untouched."""
    df = safe(df)
    bad = F.coalesce(F.col(ERROR), error if error is not None else F.lit(None).cast("string"))
    made = {}
    for n, e in exprs.items():
        v = compile_expression(e, df.schema) if isinstance(e, str) else e
        old = col(n) if n in df.columns else F.lit(None)
        made[n] = F.when(bad.isNull(), v).otherwise(old)
    return df.withColumns(made | {ERROR: bad})


def where_safe(df: DataFrame, cond: Condition, error: Column | None = None) -> DataFrame:
    """Good rows for which the condition holds, and all failed ones."""
    df = safe(df)
    bad = F.coalesce(F.col(ERROR), error if error is not None else F.lit(None).cast("string"))
    return df.withColumn(ERROR, bad).filter(F.col(ERROR).isNotNull() | condition(df, cond))


# nested and serialised data


def materialize(df: DataFrame, source: str, target: str, separator: str = ",") -> DataFrame:
    """An array as joined text in ``target``, a scalar as its text; an absent field changes nothing."""
    if source not in df.columns:
        return df
    kind = df.schema[source].dataType
    c = col(source)
    text = F.array_join(F.transform(c, lambda x: x.cast("string")), separator) if isinstance(kind, T.ArrayType) else c.cast("string")
    return df.withColumn(target, text)


def materialize_json(df: DataFrame, source: str, target: str) -> DataFrame:
    """A field as JSON text."""
    if source not in df.columns:
        return df
    kind = df.schema[source].dataType
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return df.withColumn(target, F.to_json(col(source)))
    inner = F.to_json(F.struct(col(source).alias("v")))  # {"v":...}
    return df.withColumn(target, F.when(col(source).isNull(), "null").otherwise(F.substring(inner, F.lit(6), F.length(inner) - 6)))


def hash_field(df: DataFrame, source: str, target: str) -> DataFrame:
    """SHA-256 (hex) of a field's text."""
    if source not in df.columns:
        return df
    kind = df.schema[source].dataType
    text = F.to_json(col(source)) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else col(source).cast("string")
    return df.withColumn(target, F.sha2(text, 256))


def dot_flatten(df: DataFrame, separator: str = ".", fields: Iterable[str] = ()) -> DataFrame:
    """Nested records as ``a.b`` columns, arrays walked together: one row for each place up to the shortest.

    With ``fields`` only those. Arrays inside records stay. Empty and null arrays
    vanish, and a row all of whose arrays are empty is kept once.
    """
    chosen = set(fields) or set(df.columns)
    flat: list[Column] = []
    names: list[str] = []

    def walk(c: Column, t: T.DataType, name: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(c.getField(f.name), f.dataType, f"{name}{separator}{f.name}")
        else:
            flat.append(c.alias(name))
            names.append(name)

    arrays = []
    for f in df.schema.fields:
        if f.name in chosen and isinstance(f.dataType, T.ArrayType):
            arrays.append(f.name)
        elif f.name in chosen:
            walk(col(f.name), f.dataType, f.name)
        else:
            flat.append(col(f.name))
            names.append(f.name)
    if not arrays:
        return df.select(*flat)
    some = [F.when(F.size(col(a)) > 0, F.size(col(a))) for a in arrays]
    n = F.coalesce(F.least(*some) if len(some) > 1 else some[0], F.lit(1))
    return df.select(*flat, *[col(a) for a in arrays], F.explode(F.sequence(F.lit(0), n - 1)).alias("_at")).select(
        *[col(x) for x in names], *[F.get(col(a), F.col("_at")).alias(a) for a in arrays]
    )


def cross_flatten(df: DataFrame, fields: Iterable[str] = ()) -> DataFrame:
    """One row for each combination of elements of the arrays (of ``fields``, or all); empty ones vanish, the row stays."""
    chosen = set(fields) or set(df.columns)
    out = df
    for f in df.schema.fields:
        if f.name in chosen and isinstance(f.dataType, T.ArrayType):
            out = out.select(*[F.explode_outer(col(f.name)).alias(f.name) if c == f.name else col(c) for c in out.columns])
    return out
