"""Composition of operators, branching, and errors that travel with rows.

An operator is a function from frame to frame. An error frame has a text column
``_error``: null where the row is good.
"""

from __future__ import annotations

import functools
import itertools
import queue
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path

#: Rows of a driver's iterator that are written at a time.
SPOOLED = 10_000

Operator = Callable[[DataFrame], DataFrame]
ERROR = "_error"


def chain(*operators: Operator) -> Operator:
    """One operator that applies all in turn; none at all changes nothing."""
    return lambda df: functools.reduce(DataFrame.transform, operators, df)


def pipe(first: Operator, second: Operator) -> Operator:
    return chain(first, second)


def pipe3(first: Operator, second: Operator, third: Operator) -> Operator:
    return chain(first, second, third)


def pipe_with_errors(first: Operator, second: Operator) -> Operator:
    return chain(safe, first, second)


def chain_with_errors(*operators: Operator) -> Operator:
    return chain(safe, *operators)


def from_rows(spark: SparkSession, rows: Iterable, schema=None) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def safe(df: DataFrame) -> DataFrame:
    """An error frame in which no row has failed yet."""
    return df if ERROR in df.columns else df.withColumn(ERROR, F.lit(None).cast("string"))


def unsafe(df: DataFrame) -> DataFrame:
    """The frame without ``_error``; running it raises at a failed row."""
    if ERROR not in df.columns:
        return df
    return df.filter(F.when(F.col(ERROR).isNotNull(), F.raise_error(F.col(ERROR)).cast("boolean")).otherwise(F.lit(True))).drop(ERROR)


def ignore_errors(df: DataFrame) -> DataFrame:
    return df.filter(F.col(ERROR).isNull()).drop(ERROR) if ERROR in df.columns else df


def tee(df: DataFrame, n: int, keep: bool = False) -> list[DataFrame]:
    """``n`` frames over the same rows, none for n <= 0. With ``keep`` rows are computed once and spill to disk."""
    if n <= 0:
        return []
    if keep:
        df = df.persist()
    return [df] * n


def lazy_tee(df: DataFrame, n: int) -> list[DataFrame]:
    """The same, lossless whatever the pace of those who read."""
    return tee(df, n)


def to_channel(df: DataFrame) -> Iterator[Row]:
    """Rows one by one, a partition at a time in memory."""
    return df.toLocalIterator(prefetchPartitions=True)


def to_channel_with_errors(df: DataFrame) -> tuple[Iterator[Row], list[str]]:
    """Rows up to the first failed one; its message is put in the list."""
    errors: list[str] = []

    def rows() -> Iterator[Row]:
        for r in safe(df).toLocalIterator():
            if r[ERROR] is not None:
                errors.append(r[ERROR])
                return
            yield r

    return rows(), errors


def from_channel(spark: SparkSession, items: queue.Queue, errors: queue.Queue | None, schema: str, done: object = None) -> DataFrame:
    """An error frame from what queues hold until ``done`` arrives in ``items``.

    Rows are written to the shared folder some thousands at a time, so that a queue
    may bring more than the driver holds.
    """
    path, full = new_path(spark, "channel"), f"{schema}, {ERROR} string"
    width = len(spark.createDataFrame([], schema).columns)

    def arriving() -> Iterator[tuple]:
        while (x := items.get()) is not done:
            yield (*x, None)
        while errors is not None and not errors.empty():
            yield (*[None] * width, str(errors.get()))

    return _spooled(spark, arriving(), full, path)


def _spooled(spark: SparkSession, rows: Iterator, schema, path: str) -> DataFrame:
    """Rows of an iterator as a frame over files, written ``SPOOLED`` at a time."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    while some := list(itertools.islice(rows, SPOOLED)):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(spark.createDataFrame([], schema).schema).parquet(path)


def timeout(df: DataFrame, seconds: float) -> DataFrame:
    """Rows that arrive within a wall-clock time, a partition at a time; what runs longer is cancelled.

    What has arrived lies in the shared folder, and is the frame that is returned.
    """
    spark = df.sparkSession
    tag = f"tarnflow-timeout-{uuid.uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        spark.interruptTag(tag)

    timer = threading.Timer(seconds, stop)

    def arriving() -> Iterator[Row]:
        try:
            for r in df.toLocalIterator():
                if over.is_set():
                    return
                yield r
        except Exception:
            if not over.is_set():
                raise
        finally:
            timer.cancel()
            spark.removeTag(tag)  # what has arrived is still written

    spark.addTag(tag)
    timer.start()
    return _spooled(spark, arriving(), df.schema, new_path(spark, "timeout"))
