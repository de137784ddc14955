"""Windows that batch rows: by count and by time, tumbling and sliding.

A window is one output row. Give aggregates to compute per window; without any its
rows come as an array of records (for windows that fit a row).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.access import as_time
from .grouping import Aggregate
from .ordering import needed, numbered, place

#: Seconds from the first day of year 1 to 1970; tumbling windows count from the former.
YEAR_ONE = 62_135_596_800


def _finish(df: DataFrame, by: list[str], order, aggregates: dict) -> DataFrame:
    if aggregates:
        return df.groupBy(*by).agg(*[(a.make(df, False) if isinstance(a, Aggregate) else a).alias(n) for n, a in aggregates.items()])
    rest = [c for c in df.columns if c not in by or not c.startswith("window")]
    rows = F.collect_list(F.struct(place(order).alias("o"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r")))
    return df.groupBy(*by).agg(F.transform(F.array_sort(rows), lambda x: x["r"]).alias("rows"))


def count_window(df: DataFrame, size: int, order, partition_by: Sequence[str] = (), **aggregates: Aggregate | Column) -> DataFrame:
    """Every ``size`` rows along ``order`` (the last may have fewer): ``(partition, window, ...)``, windows from 0."""
    needed(order)
    if size <= 0:
        raise ValueError("a window needs a size above 0")
    n = numbered(df, order, "_n", partition_by).withColumn("window", F.floor((F.col("_n") - 1) / size)).drop("_n")
    return _finish(n, [*partition_by, "window"], order, aggregates)


def sliding_count_window(df: DataFrame, size: int, step: int, order, partition_by: Sequence[str] = (), **aggregates: Aggregate | Column) -> DataFrame:
    """Full windows of ``size`` rows, a new one every ``step``; from ``step >= size`` on they tumble without gaps."""
    needed(order)
    if size <= 0 or step <= 0:
        raise ValueError("size and step must be above 0")
    step = min(step, size)
    n = numbered(df, order, "_n", partition_by).withColumn("_i", F.col("_n") - 1)
    # a row lies in the windows that start at multiples of step in (i - size, i]
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / step))
    high = F.floor(F.col("_i") / step)
    inside = n.select("*", F.explode(F.when(low <= high, F.sequence(low.cast("long"), high.cast("long")))).alias("window")).drop("_n", "_i")
    full = inside.groupBy(*partition_by, "window").agg(F.count("*").alias("_rows")).filter(F.col("_rows") == size).drop("_rows")
    out = _finish(inside, [*partition_by, "window"], order, aggregates)
    return out.join(full, [*partition_by, "window"], "left_semi")


def offset_seconds(seconds: int) -> int:
    """Where tumbling windows of this length begin after 1970, so that they count from year 1 (7 days: on Mondays)."""
    return -YEAR_ONE % seconds


def _timed(df: DataFrame, time: str) -> DataFrame:
    t = as_time(F.col(f"`{time}`"), df.schema[time].dataType)
    return df.withColumn("_t", t).filter("_t is not null")


def time_window(df: DataFrame, seconds: int, time: str, partition_by: Sequence[str] = (), order=None, **aggregates: Aggregate | Column) -> DataFrame:
    """Tumbling windows by time, ends excluded: ``(partition, window_start, window_end, ...)``; rows without a time are left out."""
    t = _timed(df, time)
    w = F.window("_t", f"{seconds} seconds", startTime=f"{offset_seconds(seconds)} seconds")
    return _hopped(t, w, partition_by, order or [time], aggregates)


def sliding_time_window(df: DataFrame, seconds: int, slide: int, time: str, partition_by: Sequence[str] = (), order=None, **aggregates: Aggregate | Column) -> DataFrame:
    """Windows of ``seconds`` that begin every ``slide`` seconds, aligned as tumbling ones are."""
    t = _timed(df, time)
    w = F.window("_t", f"{seconds} seconds", f"{slide} seconds", f"{offset_seconds(slide)} seconds")
    return _hopped(t, w, partition_by, order or [time], aggregates)


def _hopped(t: DataFrame, w: Column, partition_by: Sequence[str], order, aggregates: dict) -> DataFrame:
    x = t.withColumn("_w", w).withColumn("window_start", F.col("_w.start")).withColumn("window_end", F.col("_w.end")).drop("_w", "_t")
    return _finish(x, [*partition_by, "window_start", "window_end"], order, aggregates)


def emissions(df: DataFrame, slide: int, time: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Times at which an arrival-driven sliding window is emitted: the first row's, then each first one at least ``slide`` later.

    The choice goes from row to row, so each key is a scan of its distinct times.
    """
    t = _timed(df, time)
    schema = T.StructType([*[df.schema[p] for p in partition_by], T.StructField("emitted", T.TimestampNTZType())])
    gap = pd.Timedelta(seconds=slide)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for x in pdf["_t"].drop_duplicates().sort_values():
            if last is None or x >= last + gap:
                out.append(x)
                last = x
        return pd.DataFrame({**{p: pdf[p].iloc[0] for p in partition_by}, "emitted": out})

    by = list(partition_by)
    times = t.select(*by, "_t").distinct()
    if by:
        return times.groupBy(*by).applyInPandas(scan, schema)
    return times.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(scan, schema)


def sliding_time_arrival(df: DataFrame, seconds: int, slide: int, time: str, partition_by: Sequence[str] = (), order=None, **aggregates: Aggregate | Column) -> DataFrame:
    """Sliding windows as rows arrive: one per emission, holding the rows of ``(emitted - seconds, emitted]``."""
    by = list(partition_by)
    t = _timed(df, time)
    e = emissions(df, slide, time, partition_by).select(*[F.col(p).alias(f"_e_{p}") for p in by], "emitted")
    span = F.make_dt_interval(secs=F.lit(float(seconds)))
    # equal slots of the window's length turn the range condition into an equi-join: a row lies in its own slot or the one before
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    e = e.select("*", F.explode(F.array(slot("emitted"), slot("emitted") - 1)).alias("_slot"))
    t = t.withColumn("_s", slot("_t"))
    cond = (F.col("_slot") == F.col("_s")) & (F.col("_t") <= F.col("emitted")) & (F.col("_t") > F.col("emitted") - span)
    for p in by:
        cond = cond & F.col(p).eqNullSafe(F.col(f"_e_{p}"))
    x = t.join(e, cond).drop("_s", "_slot", "_t", *[f"_e_{p}" for p in by]).withColumnRenamed("emitted", "window_end")
    return _finish(x, [*by, "window_end"], order or [time], aggregates)


def session_window(df: DataFrame, gap: int, time: str, partition_by: Sequence[str] = (), **aggregates: Aggregate | Column) -> DataFrame:
    """Extension: runs of rows no more than ``gap`` seconds apart."""
    t = _timed(df, time).withColumn("_ts", F.col("_t").cast("timestamp"))
    w = F.session_window("_ts", f"{gap} seconds")
    made = [(a.make(t, False) if isinstance(a, Aggregate) else a).alias(n) for n, a in (aggregates or {"rows": F.count("*")}).items()]
    out = t.groupBy(*partition_by, w.alias("_w")).agg(*made)
    return out.select(*partition_by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[m for m in (aggregates or {"rows": 0})])

