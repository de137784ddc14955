"""Joins that overlay fields of the same name: where both sides have a value, the right one wins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full"}


def on_fields(*names: str) -> list[tuple[str, str]]:
    """Equal values in fields of the same name."""
    return [(n, n) for n in names]


def on_pairs(*pairs: tuple[str, str]) -> Callable[[DataFrame, DataFrame], Column]:
    """Fields of differing names that have the same text; both stay."""

    def made(left: DataFrame, right: DataFrame) -> Column:
        out = F.lit(True)
        for a, b in pairs:
            same = left[a] == right[b] if left.schema[a].dataType == right.schema[b].dataType else left[a].cast("string") == right[b].cast("string")
            out = out & same
        return out

    return made


def on_condition(make: Callable[[DataFrame, DataFrame], Column]) -> Callable[[DataFrame, DataFrame], Column]:
    """Any condition over both sides; equalities in it are still joined by hash or sort."""
    return make


def join(left: DataFrame, right: DataFrame, on: Sequence[str] | Sequence[tuple[str, str]] | Callable, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """``left`` joined with ``right``; fields of both sides appear once, as the right one's value where it has one.

    ``on``: field names, ``on_fields``, ``on_pairs`` or ``on_condition``. A field that is
    absent on an unmatched side is null. Null keys match nothing unless ``null_safe``.
    The order of rows is not kept. Fields whose names begin with an underscore are
    those of the left side.
    """
    if how not in HOW:
        raise ValueError(f"unknown join {how}; there are {', '.join(HOW)}")
    lefts = {c: f"_l{i}" for i, c in enumerate(left.columns)}
    rights = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    l, r = left.toDF(*lefts.values()), right.toDF(*rights.values())
    if callable(on):
        cond = on(_Named(l, lefts, left), _Named(r, rights, right))
    else:
        cond = None
        for x in on:
            a, b = (x, x) if isinstance(x, str) else x
            same = l[lefts[a]].eqNullSafe(r[rights[b]]) if null_safe else l[lefts[a]] == r[rights[b]]
            cond = same if cond is None else cond & same
    joined = l.join(r, cond, HOW[how])
    out = []
    for c in [*lefts, *[c for c in rights if c not in lefts]]:
        if c in lefts and c in rights:
            both = [F.col(rights[c]), F.col(lefts[c])]
            out.append(F.coalesce(*(both[::-1] if c.startswith("_") else both)).alias(c))
        else:
            out.append(F.col(lefts.get(c) or rights[c]).alias(c))
    return joined.select(*out)


class _Named:
    """A renamed frame by its former names."""

    def __init__(self, frame: DataFrame, names: dict[str, str], before: DataFrame):
        self._frame, self._names, self.schema, self.columns = frame, names, before.schema, before.columns

    def __getitem__(self, name: str) -> Column:
        return self._frame[self._names[name]]


def inner_join(left, right, on, **kw) -> DataFrame:
    return join(left, right, on, "inner", **kw)


def left_join(left, right, on, **kw) -> DataFrame:
    return join(left, right, on, "left", **kw)


def right_join(left, right, on, **kw) -> DataFrame:
    return join(left, right, on, "right", **kw)


def full_join(left, right, on, **kw) -> DataFrame:
    return join(left, right, on, "full", **kw)
