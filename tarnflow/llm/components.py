"""Connected components of a graph given as an edge table, on the executors alone.

Every task first replaces its edges by a forest that connects the same nodes, so
that a crowd of links is no more than its nodes. Minimum labels spread along edges and then jump to the label of their label,
which halves the distance to the root each round. Every round writes its labels
to the shared folder, so no lineage grows and a lost executor costs one round.
A hub only makes a long list in a join of two freshly shuffled sides, which
adaptive execution splits; sums by key are combined before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE_ROWS, discard, materialize
from .forest import merge, settle


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect what the edges of a task connect, one less than nodes for each group."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    ids, at = np.unique(np.concatenate([t.column(i).to_numpy() for i in (0, 1)]), return_inverse=True)
    heads = np.arange(len(ids))
    merge(heads, at[: len(t)], at[len(t) :])
    heads = settle(heads)
    tied = np.flatnonzero(heads != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[heads[tied]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` to ``(node long, label long)``: label = smallest node reachable.

    Only nodes with an edge are returned. Null ends and self-loops are ignored,
    direction and repeats do not matter; an empty table gives an empty result.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.filter("a is not null and b is not null and a <> b")
    e = materialize(e, "links")
    links, e = e, e.coalesce(e.count() // FILE_ROWS + 1).mapInArrow(_forest, "a long, b long")
    e = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    e = materialize(e.select("x.a", "x.b"), "edges")
    discard(links)
    n = e.count()
    labels = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = materialize(labels, "labels", n)
    while True:  # ends: labels only fall, and each round at least halves the way to the smallest
        spread = e.join(labels, e.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(spread, labels.node == spread.a).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        step = materialize(step, "labels", n)
        up = step.select(F.col("node").alias("up"), F.col("label").alias("far"))
        jumped = step.join(up, step.label == up.up).select("node", "old", F.least("label", "far").alias("label"))
        jumped = materialize(jumped, "labels", n)
        moved = jumped.filter("label <> old").limit(1).count()
        discard(step)
        discard(labels)
        labels = jumped.select("node", "label")
        labels._tarnflow_path = jumped._tarnflow_path
        if not moved:
            discard(e)
            return labels
