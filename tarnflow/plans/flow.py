"""``Flow``: a frame, the order of its rows, and the verbs of a record pipeline."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators import grouping, joining, prefixes, rows, running, windowing
from ..operators.grouping import Aggregate
from ..operators.ordering import Key, OrderRequired, keys
from ..sources import charts, readers, writers


class Flow:
    """Verbs return a new flow. ``order`` names the columns that order rows; file sources set it, ``sort`` replaces it,
    grouping drops it. Verbs that depend on an order raise ``OrderRequired`` where there is none."""

    def __init__(self, frame: DataFrame, order: str | Key | Sequence[str | Key] | None = None):
        self.frame, self.order = frame, keys(order)

    # sources

    @staticmethod
    def read_csv(spark: SparkSession, path: str, config: readers.CSVConfig = readers.CSVConfig(), strict: bool = False) -> Flow:
        return Flow(readers.read_csv(spark, path, config, strict), [readers.ROW])

    @staticmethod
    def read_json(spark: SparkSession, path: str) -> Flow:
        f = readers.read_json_auto(spark, path)
        return Flow(f, [readers.LINE] if readers.LINE in f.columns else None)

    @staticmethod
    def read_lines(spark: SparkSession, path: str) -> Flow:
        return Flow(readers.read_lines(spark, path), ["line_number"])

    @staticmethod
    def read_command_output(spark: SparkSession, path: str, config: readers.CommandConfig = readers.CommandConfig()) -> Flow:
        return Flow(readers.read_command_output(spark, path, config), [readers.LINE])

    @staticmethod
    def exec(spark: SparkSession, command: str, *args: str) -> Flow:
        return Flow(readers.exec_command(spark, command, args), [readers.LINE])

    @staticmethod
    def read_parquet(spark: SparkSession, path: str, order=None) -> Flow:
        return Flow(readers.read_parquet(spark, path), order)

    # plumbing

    def _with(self, frame: DataFrame, order="same") -> Flow:
        if order == "same":
            order = [k for k in self.order if k.name in frame.columns]
            order = order if len(order) == len(self.order) else None
        return Flow(frame, order)

    def _order(self, order) -> list[Key]:
        got = keys(order) or self.order
        if not got:
            raise OrderRequired("this verb depends on the order of rows: give order=")
        return got

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> Flow:
        return self._with(fn(self.frame))

    # rows

    def where(self, cond: Column | str) -> Flow:
        return self._with(rows.where(self.frame, cond))

    def where_match(self, *matches: tuple[str, str, object]) -> Flow:
        return self._with(rows.where_clauses(self.frame, [rows.Clause(matches)]))

    def where_clauses(self, *clauses: rows.Clause) -> Flow:
        return self._with(rows.where_clauses(self.frame, clauses))

    def select(self, **exprs: Column | str) -> Flow:
        return self._with(rows.select(self.frame, **exprs))

    def update(self, **values) -> Flow:
        return self._with(rows.update(self.frame, **values))

    def update_expr(self, **exprs: str) -> Flow:
        return self._with(rows.update_clauses(self.frame, [rows.Clause(set_exprs=exprs)]))

    def update_clauses(self, *clauses: rows.Clause) -> Flow:
        return self._with(rows.update_clauses(self.frame, clauses))

    def include(self, *names: str) -> Flow:
        return self._with(rows.include(self.frame, *names))

    def exclude(self, *names: str) -> Flow:
        return self._with(rows.exclude(self.frame, *names))

    def rename(self, *pairs: tuple[str, str]) -> Flow:
        return self._with(rows.rename(self.frame, *pairs))

    def flatten(self, separator: str = ".", *fields: str) -> Flow:
        return self._with(rows.dot_flatten(self.frame, separator, fields))

    def cross_flatten(self, *fields: str) -> Flow:
        return self._with(rows.cross_flatten(self.frame, fields))

    def hash(self, source: str, target: str) -> Flow:
        return self._with(rows.hash_field(self.frame, source, target))

    # order and pages

    def sort(self, *order: str | Key) -> Flow:
        return Flow(prefixes.sort(self.frame, order), order)

    def limit(self, n: int) -> Flow:
        return self._with(prefixes.limit(self.frame, n, self.order or None))

    def offset(self, n: int) -> Flow:
        return self._with(prefixes.offset(self.frame, n, self.order or None))

    def reverse(self, order=None) -> Flow:
        got = self._order(order)
        return Flow(prefixes.reverse(self.frame, got), [k.flipped() for k in got])

    def distinct(self) -> Flow:
        return self._with(prefixes.distinct(self.frame))

    def distinct_by(self, *by: str, order=None) -> Flow:
        return self._with(prefixes.distinct_by(self.frame, list(by), self._order(order)))

    def union(self, *others: Flow, all_rows: bool = False) -> Flow:
        return Flow(prefixes.union(self.frame, *[o.frame for o in others], all_rows=all_rows))

    def take_while(self, cond, order=None) -> Flow:
        return self._with(prefixes.take_while(self.frame, cond, self._order(order)))

    def take_until(self, cond, order=None) -> Flow:
        return self._with(prefixes.take_until(self.frame, cond, self._order(order)))

    def skip_while(self, cond, order=None) -> Flow:
        return self._with(prefixes.skip_while(self.frame, cond, self._order(order)))

    def skip_until(self, cond, order=None) -> Flow:
        return self._with(prefixes.skip_until(self.frame, cond, self._order(order)))

    def time_limit(self, time: str, seconds: float, order=None) -> Flow:
        return self._with(prefixes.time_limit(self.frame, time, seconds, self._order(order)))

    # combining

    def join(self, other: Flow | DataFrame, on, how: str = "inner") -> Flow:
        right = other.frame if isinstance(other, Flow) else other
        return self._with(joining.join(self.frame, right, on, how))

    def group_by(self, *names: str, **aggregates: Aggregate | Column) -> Flow:
        return Flow(grouping.group_by_fields(self.frame, *names).aggregate(**aggregates))

    def group_by_key(self, name: str, key: Column | str, **aggregates: Aggregate | Column) -> Flow:
        return Flow(grouping.group_by(self.frame, name, key).aggregate(**aggregates))

    # along the order

    def running_sum(self, field: str, order=None, partition_by=()) -> Flow:
        return self._with(running.running_sum(self.frame, field, self._order(order), partition_by))

    def running_average(self, field: str, size: int, order=None, partition_by=()) -> Flow:
        return self._with(running.running_average(self.frame, field, size, self._order(order), partition_by))

    def running_min_max(self, field: str, order=None, partition_by=()) -> Flow:
        return self._with(running.running_min_max(self.frame, field, self._order(order), partition_by))

    def running_count(self, field: str, order=None, partition_by=()) -> Flow:
        return self._with(running.running_count(self.frame, field, self._order(order), partition_by))

    def ema(self, field: str, alpha: float, order=None, partition_by=()) -> Flow:
        return self._with(running.exponential_moving_average(self.frame, field, alpha, self._order(order), partition_by))

    def count_window(self, size: int, order=None, partition_by=(), **aggregates) -> Flow:
        return Flow(windowing.count_window(self.frame, size, self._order(order), partition_by, **aggregates))

    def sliding_count_window(self, size: int, step: int, order=None, partition_by=(), **aggregates) -> Flow:
        return Flow(windowing.sliding_count_window(self.frame, size, step, self._order(order), partition_by, **aggregates))

    def time_window(self, seconds: int, time: str, partition_by=(), **aggregates) -> Flow:
        return Flow(windowing.time_window(self.frame, seconds, time, partition_by, **aggregates))

    def sliding_time_window(self, seconds: int, slide: int, time: str, partition_by=(), mode: str = "aligned", **aggregates) -> Flow:
        fn = windowing.sliding_time_window if mode == "aligned" else windowing.sliding_time_arrival
        return Flow(fn(self.frame, seconds, slide, time, partition_by, **aggregates))

    # sinks

    def write_csv(self, path: str, **kw) -> None:
        writers.write_csv(self.frame, path, **kw)

    def write_json(self, path: str, **kw) -> None:
        writers.write_json(self.frame, path, **kw)

    def write_lines(self, path: str, **kw) -> None:
        writers.write_lines(self.frame, path, **kw)

    def table(self, max_width: int = 50) -> str:
        return writers.format_table(self.frame, max_width)

    def chart(self, x: str, y: str, path: str) -> None:
        charts.quick_chart(self.frame, x, y, path)
