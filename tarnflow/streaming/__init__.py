"""Structured Streaming forms of operators whose batch forms need the whole input."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.grouping import Aggregate
from ..operators.windowing import offset_seconds


def read_stream(spark: SparkSession, path: str, schema, form: str = "parquet", **options) -> DataFrame:
    """Files that arrive in a folder, as rows."""
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.format(form).load(path)


def event_time(df: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark: rows more than ``late`` behind the latest time are dropped by windows. Times without zone are taken as the session's."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def time_window(df: DataFrame, seconds: int, time: str, late: str, partition_by: Sequence[str] = (), slide: int | None = None, **aggregates: Aggregate | Column) -> DataFrame:
    """Tumbling or sliding windows of a stream, emitted once the watermark has passed them."""
    marked = event_time(df, time, late)
    hop = slide or seconds
    w = F.window(time, f"{seconds} seconds", f"{hop} seconds", f"{offset_seconds(hop)} seconds")
    made = [(a.make(marked, False) if isinstance(a, Aggregate) else a).alias(n) for n, a in aggregates.items()]
    out = marked.groupBy(*partition_by, w.alias("_w")).agg(*made)
    return out.select(*partition_by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *aggregates)


def running_sum(df: DataFrame, key: str, field: str, time: str) -> DataFrame:
    """Running count, sum and mean per key, along ``time`` within each micro-batch; the state is two numbers a key."""

    def step(k, frames: Iterable[pd.DataFrame], state: GroupState):
        n, total = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        values = pd.to_numeric(rows[field], errors="coerce").fillna(0.0).astype(float)
        sums = total + values.cumsum()
        counts = n + pd.Series(range(1, len(rows) + 1), index=rows.index)
        state.update((int(counts.iloc[-1]), float(sums.iloc[-1])))
        yield pd.DataFrame({key: rows[key], time: rows[time], "running_count": counts, "running_sum": sums, "running_avg": sums / counts})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, running_count long, running_sum double, running_avg double"
    return df.groupBy(key).applyInPandasWithState(step, schema, "n long, total double", "append", GroupStateTimeout.NoTimeout)


def count_window(df: DataFrame, key: str, field: str, size: int, time: str) -> DataFrame:
    """Every ``size`` rows of a key: ``(key, window, count, sum)``; values that do not fill a window wait in the state."""

    def step(k, frames: Iterable[pd.DataFrame], state: GroupState):
        window, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        held = list(held) + pd.to_numeric(rows[field], errors="coerce").fillna(0.0).astype(float).tolist()
        out = []
        while len(held) >= size:
            out.append((k[0], window, size, float(sum(held[:size]))))
            held, window = held[size:], window + 1
        state.update((window, held))
        yield pd.DataFrame(out, columns=[key, "window", "count", "sum"])

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, window long, count long, sum double", "window long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def exponential_moving_average(df: DataFrame, key: str, field: str, alpha: float, time: str) -> DataFrame:
    """The EMA per key, along ``time`` within each micro-batch; the state is one number a key."""

    def step(k, frames: Iterable[pd.DataFrame], state: GroupState):
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        out = []
        for v in pd.to_numeric(rows[field], errors="coerce").fillna(0.0):
            now = float(v) if now is None else alpha * float(v) + (1 - alpha) * now
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({key: rows[key], time: rows[time], "ema": out, "alpha": alpha})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, ema double, alpha double", "ema double", "append", GroupStateTimeout.NoTimeout)


def tee(df: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Every micro-batch to all sinks, each row computed once."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_files(df: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> None:
    """All that is available into files; a folder for the state of what is written lies beside."""
    q = df.writeStream.format(form).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append", seconds: float | None = None) -> StreamingQuery:
    """All that is available into an in-memory table; after ``seconds`` the query is stopped."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(seconds) if seconds is not None else q.awaitTermination()
    if q.isActive:
        q.stop()
    return q
