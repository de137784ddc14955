"""Operators on frames; each module holds one family."""

from . import composing, grouping, joining, ordering, prefixes, rows, running, windowing

__all__ = ["composing", "grouping", "joining", "ordering", "prefixes", "rows", "running", "windowing"]
