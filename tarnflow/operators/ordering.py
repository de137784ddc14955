"""Explicit order of rows, and work along it that does not end up in one task.

A frame has no order of its own, so whatever depends on one is told by which
columns. Work along a whole table (no ``partition_by``) is done in ranges: rows are
dealt by bounds of the leading order column, every range is worked on by itself, and
what earlier ranges hand on (a count, a sum) is one small row per range.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Ranges for each shuffle partition, and rows drawn for each range to place the bounds.
RANGES, DRAWN = 2, 100


class OrderRequired(ValueError):
    """An operator depends on the order of rows and none is known."""


@dataclass(frozen=True)
class Key:
    """An order column and its direction. Nulls come first ascending, last descending."""

    name: str
    desc: bool = False

    @staticmethod
    def of(x: str | Key) -> Key:
        if isinstance(x, Key):
            return x
        return Key(x[1:], True) if x.startswith("-") else Key(x)

    @property
    def col(self) -> Column:
        c = F.col(f"`{self.name}`")
        return c.desc_nulls_last() if self.desc else c.asc_nulls_first()

    def flipped(self) -> Key:
        return Key(self.name, not self.desc)


def keys(order: str | Key | Sequence[str | Key] | None) -> list[Key]:
    """Order columns from names; ``-name`` is descending."""
    if order is None:
        return []
    return [Key.of(x) for x in ([order] if isinstance(order, (str, Key)) else order)]


def needed(order) -> list[Key]:
    got = keys(order)
    if not got:
        raise OrderRequired("this operator depends on the order of rows: name the columns it goes by")
    return got


def sort_columns(order) -> list[Column]:
    return [k.col for k in keys(order)]


def window(order, partition_by: Sequence[str] = ()) -> WindowSpec:
    spec = Window.partitionBy(*[F.col(f"`{p}`") for p in partition_by])
    return spec.orderBy(*sort_columns(order))


def running(order, partition_by: Sequence[str] = ()) -> WindowSpec:
    return window(order, partition_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ranged(df: DataFrame, order, name: str = "_range") -> DataFrame:
    """``df`` with the number of its range: rows of an earlier range come before those of a later one.

    Bounds are drawn from a sample of the order columns as far as all go one way, so
    rows alike in the first are still parted by the others. There are as many ranges
    as ``RANGES`` times the shuffle partitions, which a caller sets by the table.
    """
    by = needed(order)
    by = [k for i, k in enumerate(by) if all(x.desc == by[0].desc for x in by[: i + 1])]
    n = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.struct(*[F.col(f"`{k.name}`").alias(f"k{i}") for i, k in enumerate(by)])
    drawn = df.select(at.alias("k"))
    total = drawn.count()
    if total > DRAWN * n:
        drawn = drawn.sample(False, DRAWN * n / total, seed=1)
    drawn = drawn.select("k", F.ntile(n).over(Window.orderBy("k")).alias("t")).groupBy("t").agg(F.min("k").alias("k"))  # a sample of bounded size
    bounds = [r.k for r in drawn.orderBy("t").collect()]
    bounds = [b for i, b in enumerate(bounds) if i and b != bounds[i - 1]]
    kind = df.select(at.alias("k")).schema["k"].dataType
    lits = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind.fields, strict=True)]) for b in bounds]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(at < lits[mid], search(low, mid)).otherwise(search(mid + 1, high))

    found = search(0, len(lits))
    return df.withColumn(name, (-found if by[0].desc else found).cast("int"))


def numbered(df: DataFrame, order, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the 1-based place of each row along ``order`` (within ``partition_by``)."""
    if partition_by:
        return df.withColumn(name, F.row_number().over(window(order, partition_by)).cast("long"))
    r = ranged(df, order)
    sizes = r.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = sizes.select(F.col("_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = r.join(F.broadcast(sizes), "_range")
    out = out.withColumn(name, (F.row_number().over(Window.partitionBy("_range").orderBy(*sort_columns(order))) + F.col("_before")).cast("long"))
    return out.drop("_range", "_before")


_FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def carried(df: DataFrame, order, amounts: dict[str, tuple[str, Column]], partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` with running sums, minima or maxima up to and with each row: ``{name: (how, amount)}``."""
    if partition_by:
        return df.withColumns({n: _FOLDS[how](c).over(running(order, partition_by)) for n, (how, c) in amounts.items()})
    held = {n: f"_amount{i}" for i, n in enumerate(amounts)}
    r = ranged(df.withColumns({held[n]: c for n, (_, c) in amounts.items()}), order)
    folds = {n: _FOLDS[how] for n, (how, _) in amounts.items()}
    whole = r.groupBy("_range").agg(*[folds[n](held[n]).alias(held[n]) for n in amounts])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    whole = whole.select("_range", *[folds[n](held[n]).over(before).alias(f"_before{held[n]}") for n in amounts])
    within = Window.partitionBy("_range").orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {}
    for n, (how, _) in amounts.items():
        here, past = folds[n](held[n]).over(within), F.col(f"_before{held[n]}")
        made[n] = {"sum": F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0)), "min": F.least(here, past), "max": F.greatest(here, past)}[how]
    out = r.join(F.broadcast(whole), "_range").withColumns(made)
    return out.drop("_range", *held.values(), *[f"_before{h}" for h in held.values()])


def place(order) -> Column:
    """The order of a row as one comparable value: a struct of its order columns (ascending ones only)."""
    if any(k.desc for k in needed(order)):
        raise OrderRequired("an ascending order is needed here")
    return F.struct(*[F.col(f"`{k.name}`") for k in keys(order)])
