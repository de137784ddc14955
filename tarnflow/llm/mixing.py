"""Mixing sources to target weights by fitting a budget of words exactly.

Per source: whole copies first, then a subset-sum over the remaining budget. The
documents are counted by exact length, and a bounded knapsack over (length,
count) finds how many documents of each length to take so that their words come
as near the budget as the lengths allow. Within a length the documents with the
smallest seeded hash are taken. The knapsack sees only the counts, one row per
distinct length, never the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import cut, fresh, materialize, small_batches, texts

#: Words of a source's budget that the exact knapsack covers at once; what a budget has beyond is taken greedily first.
EXACT_WORDS = 1 << 18
#: Hash ranges into which a length is cut to rank its documents without one long sort.
RANGES = 1 << 12


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, source, size)``, size = runs of non-space characters (null text: 0)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            n = [len(t.encode("utf-8", "surrogatepass").split()) for t in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["id", "source", "size"])

    return docs.select(F.col(id_col).cast("long"), F.col(source_col).cast("string"), text_col).mapInArrow(run, "id long, source string, size long")


def targets(sizes: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """``sizes(source, source_size)`` with ``target double``: shares of the total by weight, none above ``cap`` times its size.

    Sources take the weights in turn by code point of their name, null last. The
    excess of those above their cap is shared among the others until none is above:
    a share is ``level`` times the weight, and the level only rises, so each round is
    one sum over the sources. Sources may be as many as they like; two numbers a
    round reach the driver.
    """
    named = numbered(sizes.filter("source is not null"), "source", "place")
    last = sizes.filter("source is null").withColumn("place", F.lit(sizes.filter("source is not null").count() + 1).cast("long"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    plan = named.unionByName(last).withColumn("weight", turn)
    plan = materialize(plan.withColumn("edge", F.when(F.col("source_size") > 0, F.col("source_size") * float(cap) / F.col("weight"))), "sources")
    total = plan.agg(F.sum("source_size")).head()[0] or 0
    level, known = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("edge") < level
        got = plan.filter("edge is not null").agg(F.sum(F.when(above, F.col("source_size")).otherwise(0)).alias("held"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(F.when(above, 1).otherwise(0)).alias("n")).head()
        if got.n == known or not got.open:
            break
        level, known = (total - cap * got.held) / got.open, got.n
    full = F.col("source_size") * float(cap)
    share = full if level is None or not got.open else F.when(F.col("edge") < level, full).otherwise(F.col("weight") * level)
    return plan.select("source", "source_size", F.when(F.col("edge").isNull(), 0.0).otherwise(share).cast("double").alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT_WORDS) -> np.ndarray:
    """How many of each length to take so that the words come as near ``budget`` as can be.

    Long budgets are first filled in proportion, in whole documents, down to at
    most ``exact`` words; the knapsack then fits the rest exactly from what is left.
    """
    take = np.zeros(len(sizes), np.int64)
    if budget <= 0 or not len(sizes):
        return take
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.astype(np.int64).copy()
    if budget > exact:
        part = (budget - exact // 2) / total
        take = np.floor(counts * part).astype(np.int64)
        budget -= int((take * sizes).sum())
    order = np.argsort(-sizes)
    if budget > exact:  # rounding down left more: one more of the longest lengths, while they fit
        for i in order:
            if budget <= exact // 2:
                break
            more = min(int(counts[i] - take[i]), max(0, (budget - exact // 4) // int(sizes[i])) if sizes[i] else 0)
            take[i] += more
            budget -= more * int(sizes[i])
    left = counts - take
    usable = order[(left[order] > 0) & (sizes[order] > 0) & (sizes[order] <= 2 * budget)]
    top = int(min(2 * budget, (left * sizes)[usable].sum()))  # beyond twice the budget taking nothing is nearer
    # reach[w]: index of the last length used to make w words, spare copies by binary splitting
    reach = np.full(top + 1, -1, np.int64)
    reach[0] = len(sizes) * 64
    items = []
    for i in usable:
        have, k = min(int(left[i]), top // int(sizes[i])), 1
        while have > 0:
            k_now = min(k, have)
            items.append((int(i), k_now, k_now * int(sizes[i])))
            have -= k_now
            k *= 2
    for j, (_, _, w) in enumerate(items):
        if budget <= top and reach[budget] >= 0:
            break
        if w > top:
            continue
        new = (reach[w:] < 0) & (reach[:-w] >= 0)
        reach[w:][new] = j
    made = np.flatnonzero(reach >= 0)
    w = int(made[np.argmin(np.abs(made - budget))])
    while w:
        i, k, step = items[reach[w]]
        take[i] += k
        w -= step
    return take


def mix(docs: DataFrame, weights: list[float] = (1, 2, 3), cap: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: ``(id, source, size, source_size, target, copies, taken)``.

    ``copies`` (0 to ``cap``) times ``size`` is ``taken``. Sizes are whole texts'
    words; null and empty texts have size 0 and are taken like the base copies of
    their source. Rows rank by a hash of id and length alone, so a rerun gives the
    same; rows that repeat an id and a length count each, but are taken together. A
    source that is null is a source. An empty table gives no rows. Extra columns are
    not read.

    The counts by length are fitted by the executors, a source at a time. A text is
    never cut, however long.
    """
    sized = materialize(word_counts(docs, id_col, text_col, source_col), "sizes")
    lengths = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    per_source = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = targets(materialize(per_source, "per_source"), list(weights), cap)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        size, target = int(pdf.source_size[0]), float(pdf.target[0])
        base = min(int(target // size), cap) if size else 0
        budget = round(target) - base * size
        extra = fit_counts(pdf["size"].to_numpy(), pdf.n.to_numpy(), budget if base < cap else 0)
        return pdf.assign(base=base, extra=extra)[["source", "size", "n", "source_size", "target", "base", "extra"]]

    plan = plan.withColumnRenamed("source", "of")
    fitted = lengths.join(plan, lengths.source.eqNullSafe(plan.of)).select("source", "size", "n", "source_size", "target")
    fitted = materialize(fitted.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, base int, extra long"), "fitted")
    parts = fitted.filter("extra > 0 and extra < n").select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "extra")

    # which documents of a partly taken length: the smallest hashes; ranked by ranges of the hash
    hashed = sized.withColumn("h", F.xxhash64(F.lit(seed), "id", "size")).withColumn("r", F.shiftright("h", 52))
    drawn = hashed.join(parts, hashed.source.eqNullSafe(F.col("p_source")) & (hashed.size == F.col("p_size")))
    drawn = materialize(drawn.select("id", "source", "size", "h", "r", "extra"), "drawn")
    spread = drawn.groupBy("source", "size", "r").agg(F.count("*").alias("c"), F.min("extra").alias("extra"))
    upto = Window.partitionBy("source", "size").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    edge = spread.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0))).filter("before < extra")
    edge = materialize(edge.select(F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("r").alias("e_r"), "before"), "edge")
    inside = drawn.join(edge, drawn.source.eqNullSafe(F.col("e_source")) & (drawn.size == F.col("e_size")) & (drawn.r == F.col("e_r")))
    place = Window.partitionBy("source", "size", "r").orderBy("h", "id")
    last = inside.withColumn("place", F.row_number().over(place) + F.col("before")).filter("place = extra")
    last = last.select(F.col("source").alias("l_source"), F.col("size").alias("l_size"), F.col("h").alias("l_h"), F.col("id").alias("l_id"))

    on = fitted.source.eqNullSafe(F.col("l_source")) & (fitted.size == F.col("l_size"))
    whole = fitted.join(last, on, "left")
    whole = materialize(whole.select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), "n", "source_size", "target", "base", "extra", "l_h", "l_id"), "whole")
    out = hashed.join(whole, hashed.source.eqNullSafe(F.col("f_source")) & (hashed.size == F.col("f_size")))
    none = F.lit(-(1 << 63))
    upto_last = (F.col("h") < F.col("l_h")) | ((F.col("h") == F.col("l_h")) & (F.coalesce("id", none) <= F.coalesce("l_id", none)))
    more = F.when(F.col("extra") >= F.col("n"), 1).when(upto_last, 1).otherwise(0)
    out = out.withColumn("copies", (F.col("base") + more).cast("int"))
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def resample(docs: DataFrame, weights: list[float] = (1, 2, 3), cap: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it (0 to ``cap`` times); same columns, clashing names included.

    Rows that repeat an id and a size get the same number of copies; rows without an
    id or a source take part; null and empty texts are taken like the base copies of
    their source. An empty table gives no rows.
    """
    key, origin, copies, copy = fresh(docs, "_id", "_source", "_copies", "_copy")
    taken = mix(docs, weights, cap, seed, id_col, text_col, source_col)
    taken = taken.groupBy("id", "source").agg(F.max("copies").alias("copies")).filter("copies > 0")
    taken = materialize(taken.select(F.col("id").alias(key), F.col("source").alias(origin), F.col("copies").alias(copies)), "taken")
    on = docs[id_col].cast("long").eqNullSafe(F.col(key)) & docs[source_col].cast("string").eqNullSafe(F.col(origin))
    joined = docs.join(taken.hint("merge"), on).select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), copies)).alias(copy))
    return joined.drop(copy)
