"""What a chart needs to know of a frame: types, statistics, categories; one pass for all fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.access import as_time, is_time

#: Share of values that decides a field's type, and categories kept of a text field.
SHARE, CATEGORIES = 0.8, 50


@dataclass(frozen=True)
class FieldProfile:
    name: str
    kind: str  # numeric, date or string
    count: int
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    stddev: float | None = None
    categories: tuple[str, ...] = ()


def profile(df: DataFrame) -> list[FieldProfile]:
    """Profiles of all scalar fields without a leading underscore, by name; the deviation is that of the population."""
    fields = sorted((f for f in df.schema.fields if not f.name.startswith("_") and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))), key=lambda f: f.name)
    aggs = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        n = F.lit(None).cast("double") if isinstance(f.dataType, T.BooleanType) or is_time(f.dataType) else c.try_cast("double")
        t = as_time(c, f.dataType) if isinstance(f.dataType, T.StringType) or is_time(f.dataType) else F.lit(None).cast("timestamp_ntz")
        aggs += [F.count(c).alias(f"c{i}"), F.count(n).alias(f"n{i}"), F.count(t).alias(f"t{i}"), F.min(n).alias(f"lo{i}"), F.max(n).alias(f"hi{i}"), F.avg(n).alias(f"m{i}"), F.stddev_pop(n).alias(f"s{i}")]
    if not fields:
        return []
    got = df.agg(*aggs).head()
    out = []
    for i, f in enumerate(fields):
        total = got[f"c{i}"]
        if total and got[f"n{i}"] > SHARE * total:
            out.append(FieldProfile(f.name, "numeric", total, got[f"lo{i}"], got[f"hi{i}"], got[f"m{i}"], got[f"s{i}"]))
        elif total and got[f"t{i}"] > SHARE * total:
            out.append(FieldProfile(f.name, "date", total))
        else:
            some = df.select(F.col(f"`{f.name}`").cast("string").alias("v")).filter("v is not null").distinct().orderBy("v").limit(CATEGORIES)
            out.append(FieldProfile(f.name, "string", total, categories=tuple(r.v for r in some.collect())))
    return out
