"""Cut a table into ranges of its id, each a run of neighbouring ids, without sorting it whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Ranges for each shuffle partition; several, so that uneven ranges even out.
PER_PARTITION = 4


def id_bounds(df: DataFrame, id_col: str, per_partition: int = PER_PARTITION) -> list[int]:
    """Lower ends of all ranges but the first, about evenly many rows each."""
    n = per_partition * partitions(df.sparkSession)
    at = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(F.col(id_col).cast("long"), at, 20_000)).head()[0]
    return sorted(set(got or []))


#: Bounds that are still searched by nested comparisons; more are searched by a Python function.
NESTED = 2048


def range_of(bounds: list[int], null_high: bool):
    """A column function: id to the number of its range; null ids go to the last range, or to the first."""
    null = len(bounds) if null_high else 0
    if len(bounds) <= NESTED:

        def search(c: Column, low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(c < bounds[mid], search(c, low, mid)).otherwise(search(c, mid + 1, high))

        return lambda name: F.when(F.col(name).isNull(), null).otherwise(search(F.col(name), 0, len(bounds)))

    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def number(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in ids:
            out = np.searchsorted(edges, x.fillna(0).astype("int64").to_numpy(), side="right").astype(np.int32)
            out[x.isna().to_numpy()] = null
            yield pd.Series(out)

    return number
