"""Running analytics along an order, per ``partition_by`` or over the whole table.

Missing or unparseable numbers count as 0, as the fixed output names suggest; with
``skip_missing`` they are left out instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.access import get
from .ordering import carried, keys, needed, numbered, ranged, sort_columns, window


def _number(df: DataFrame, field: str, skip_missing: bool) -> Column:
    v = get(df, field, float)
    return v if skip_missing else F.coalesce(v, F.lit(0.0))


def running_sum(df: DataFrame, field: str, order, partition_by: Sequence[str] = (), skip_missing: bool = False) -> DataFrame:
    """Adds ``running_sum``, ``running_count`` and ``running_avg``."""
    needed(order)
    v = _number(df, field, skip_missing)
    one = F.when(v.isNotNull(), 1).otherwise(0).cast("long")
    out = carried(df, order, {"running_sum": ("sum", F.coalesce(v, F.lit(0.0))), "running_count": ("sum", one)}, partition_by)
    return out.withColumn("running_avg", F.try_divide("running_sum", "running_count"))


def running_average(df: DataFrame, field: str, size: int, order, partition_by: Sequence[str] = ()) -> DataFrame:
    """Adds ``moving_avg`` over the last ``size`` rows, ``window_size`` (rows in it) and ``total_count``; no rows for size <= 0."""
    needed(order)
    if size <= 0:
        return df.limit(0).withColumns({"moving_avg": F.lit(0.0), "window_size": F.lit(0).cast("long"), "total_count": F.lit(0).cast("long")})
    v = _number(df, field, False)
    n = numbered(df.withColumn("_v", v), order, "total_count", partition_by)
    if partition_by:
        frame = window(order, partition_by).rowsBetween(-(size - 1), 0)
        out = n.withColumn("moving_avg", F.avg("_v").over(frame))
    else:  # blocks of `size` rows: a row's window reaches into its own block and the one before
        block = F.floor((F.col("total_count") - 1) / size)
        both = n.withColumn("_own", block).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_next")).withColumn("_block", F.col("_own") + F.col("_next"))
        frame = Window.partitionBy("_block").orderBy("total_count").rowsBetween(-(size - 1), 0)
        out = both.withColumn("moving_avg", F.avg("_v").over(frame)).filter("_next = 0").drop("_own", "_next", "_block")
    return out.withColumn("window_size", F.least(F.col("total_count"), F.lit(size)).cast("long")).drop("_v")


def running_min_max(df: DataFrame, field: str, order, partition_by: Sequence[str] = (), skip_missing: bool = False) -> DataFrame:
    """Adds ``running_min``, ``running_max`` and ``running_range``."""
    needed(order)
    v = _number(df, field, skip_missing)
    out = carried(df, order, {"running_min": ("min", v), "running_max": ("max", v)}, partition_by)
    return out.withColumn("running_range", F.col("running_max") - F.col("running_min"))


def running_count(df: DataFrame, field: str, order, partition_by: Sequence[str] = (), with_map: bool = True) -> DataFrame:
    """Adds ``total_count``, ``distinct_values`` and the map ``distinct_counts`` of values so far, as at each row.

    Values count by their text, a missing one as ``<nil>``. The map grows with the
    number of distinct values; leave it out (``with_map=False``) where there are many.
    """
    needed(order)
    v = F.coalesce(get(df, field, str), F.lit("<nil>"))
    if partition_by and with_map:
        added = [T.StructField("total_count", T.LongType()), T.StructField("distinct_values", T.LongType()), T.StructField("distinct_counts", T.MapType(T.StringType(), T.LongType()))]
        return _by_key(df.withColumn("_v", v), order, partition_by, added, _tallies)
    out = numbered(df.withColumn("_v", v), order, "total_count", partition_by)
    lead = keys(order)
    mine = Window.partitionBy(*partition_by, "_v").orderBy(*sort_columns(order))
    out = out.withColumn("_nth", F.row_number().over(mine).cast("long"))
    out = carried(out, lead, {"distinct_values": ("sum", F.when(F.col("_nth") == 1, 1).otherwise(0).cast("long"))}, partition_by)
    if with_map:
        out = _maps(out)
    return out.drop("_v", "_nth")


def _tallies(values: list[list], state: dict | None) -> tuple[list[pa.Array], dict]:
    """Counts so far, after each value of each run; the first run goes on from ``state``, the others are new keys."""
    totals, sizes, offsets, keys_, counts = [], [], [0], [], []
    for i, run in enumerate(values):
        now = state if i == 0 and state is not None else {}
        total = sum(now.values())
        for v in run:
            now[v] = now.get(v, 0) + 1
            total += 1
            totals.append(total)
            sizes.append(len(now))
            keys_.extend(now)
            counts.extend(now.values())
            offsets.append(len(keys_))
    maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys_, pa.string()), pa.array(counts, pa.int64()))
    return [pa.array(totals, pa.int64()), pa.array(sizes, pa.int64()), maps], now


#: Neighbouring rows of a key whose maps are made together, from one map of what lies before them.
STRETCH = 8192


def _maps(df: DataFrame) -> DataFrame:
    """Adds ``distinct_counts``: what earlier stretches of rows counted, and what the row's own stretch has so far.

    Counts by stretch and value are summed along the stretches in one window by
    value. A stretch gets the last count of each value before it and is one group of
    at most ``STRETCH`` rows.
    """
    rows = df.withColumn("_stretch", F.floor((F.col("total_count") - 1) / STRETCH))
    # a value's count before a stretch changes only after a stretch that holds it
    values = Window.partitionBy("_v").orderBy("_stretch")
    last = rows.agg(F.max("_stretch")).head()[0]
    sums = rows.groupBy("_stretch", "_v").agg(F.max("_nth").alias("_c"))
    sums = sums.withColumn("_until", F.coalesce(F.lead("_stretch").over(values), F.lit(last))).filter(F.col("_stretch") < F.col("_until"))
    spread = F.explode(F.sequence(F.col("_stretch") + 1, F.col("_until")))
    before = sums.select(spread.alias("_s"), F.col("_v").alias("_past"), F.col("_c").alias("_times"))
    schema = T.StructType([*df.schema.fields, T.StructField("distinct_counts", T.MapType(T.StringType(), T.LongType()))])

    def count(here: pa.Table, past: pa.Table) -> pa.Table:
        here = here.sort_by("total_count")
        now = dict(zip(past["_past"].to_pylist(), past["_times"].to_pylist(), strict=True)) if past.num_rows else {}
        made, _ = _tallies([here["_v"].to_pylist()], now)
        return here.drop_columns(["_stretch"]).append_column("distinct_counts", made[2])

    return rows.groupBy("_stretch").cogroup(before.groupBy("_s")).applyInArrow(count, schema)


def exponential_moving_average(df: DataFrame, field: str, alpha: float, order, partition_by: Sequence[str] = ()) -> DataFrame:
    """Adds ``ema`` (the first value, then ``alpha * value + (1 - alpha) * ema``) and ``alpha``.

    Per key a scan; over a whole table each range is scanned by itself and what it
    starts from, which only scales by powers of ``1 - alpha``, is put in afterwards.
    """
    needed(order)
    v = _number(df, field, False)
    base = df.withColumn("_v", v)
    fields = [f for f in base.schema.fields if f.name != "_v"]
    added = [T.StructField("ema", T.DoubleType()), T.StructField("alpha", T.DoubleType())]
    if partition_by:

        def averages(values: list[list], now: float | None) -> tuple[list[pa.Array], float]:
            out: list[float] = []
            for i, run in enumerate(values):
                out.extend(_ema(run, alpha, now if i == 0 else None))
            return [pa.array(out, pa.float64()), pa.array(np.full(len(out), alpha))], out[-1]

        return _by_key(base, order, partition_by, added, averages)
    n = numbered(base, order, "_n")
    r = ranged(n, order)
    # a range's own part: sum of weight * (1 - alpha) ** (rows after it in the range)
    whole = Window.partitionBy("_range")
    weighted = r.withColumn("_after", F.max("_n").over(whole) - F.col("_n"))
    part = F.col("_v") * F.when(F.col("_n") == 1, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), "_after")
    ranges = weighted.groupBy("_range").agg(F.sum(part).alias("own"), F.count("*").alias("n")).orderBy("_range").collect()  # a row per range
    start, carry = {}, None
    for x in ranges:
        start[x["_range"]] = carry
        carry = x.own if carry is None else x.own + (1 - alpha) ** x.n * carry
    schema = T.StructType([*fields, *added])

    def scan_range(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        return pdf.assign(ema=list(_ema(pdf["_v"], alpha, start[int(key[0])])), alpha=alpha).drop(columns=["_v", "_n", "_range"])

    return r.groupBy("_range").applyInPandas(scan_range, schema)


def _ema(values, alpha: float, now: float | None) -> Iterator[float]:
    for v in values:
        now = v if now is None else alpha * v + (1 - alpha) * now
        yield now


def _by_key(df: DataFrame, order, partition_by: Sequence[str], added: list[T.StructField], work: Callable[[list[list], object], tuple[list[pa.Array], object]]) -> DataFrame:
    """Keys stream one after the other, rows in order; what is held is the state of the key at hand.

    ``work(values, state)`` takes the values ``_v`` of a batch, a list for each key, and
    the state in which the first of them is (None: a new key); it gives the ``added``
    columns and the state of the last.
    """
    by = [F.col(f"`{p}`") for p in partition_by]
    dealt = df.repartition(*by).sortWithinPartitions(*by, *sort_columns(order))
    at, value = [df.columns.index(p) for p in partition_by], df.columns.index("_v")
    schema = T.StructType([f for f in df.schema.fields if f.name != "_v"] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            ends = _turns([b.column(i) for i in at])
            first, final = ([b.column(i)[row].as_py() for i in at] for row in (0, n - 1))
            v = b.column(value).to_pylist()
            made, state = work([v[lo:hi] for lo, hi in zip([0, *ends], [*ends, n], strict=True)], state if first == last else None)
            last = final
            rest = [b.column(i) for i in range(b.num_columns) if i != value]
            yield pa.RecordBatch.from_arrays([*rest, *made], names=schema.names)

    return dealt.mapInArrow(run, schema)


def _turns(columns: list[pa.Array]) -> list[int]:
    """Rows that differ in some column from the row before them."""
    n = len(columns[0])
    turn = np.zeros(max(0, n - 1), bool)
    for c in columns:
        codes = c.dictionary_encode("encode").indices.to_numpy()
        turn |= codes[1:] != codes[:-1]
    return (np.flatnonzero(turn) + 1).tolist()
