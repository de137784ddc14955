import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_helpers import frame, odd_texts, prose
from tarnflow.llm import mixing


def brute_nearest(sizes, counts, budget):
    """The smallest distance to the budget that any choice of documents has."""
    reach = {0}
    for s, c in zip(sizes, counts):
        reach = {x + k * s for x in reach for k in range(c + 1)}
    return min(abs(x - budget) for x in reach)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 400))
def test_knapsack_is_as_near_as_can_be(lengths, budget):
    sizes, counts = np.array(sorted(lengths)), np.array([lengths[k] for k in sorted(lengths)])
    take = mixing.fit_counts(sizes, counts, budget)
    assert ((take >= 0) & (take <= counts)).all()
    assert abs(int((take * sizes).sum()) - budget) == brute_nearest(sizes.tolist(), counts.tolist(), budget)


def test_long_budgets_are_filled_greedily_first():
    rng = np.random.default_rng(1)
    sizes = np.unique(rng.integers(5, 9000, 900))
    counts = rng.integers(1, 60, len(sizes))
    total = int((sizes * counts).sum())
    for share in (0.01, 0.3, 0.77, 0.999):
        budget = int(total * share)
        take = mixing.fit_counts(sizes, counts, budget, exact=1 << 16)
        assert ((take >= 0) & (take <= counts)).all()
        assert abs(int((take * sizes).sum()) - budget) <= 5


def brute_targets(sizes, weights, cap):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = dict.fromkeys(names, 0.0), {s for s in names if sizes[s]}, float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > cap * sizes[s]}
        if not above:
            out |= share
            break
        out |= {s: cap * sizes[s] for s in above}
        left -= sum(cap * sizes[s] for s in above)
        open_ -= above
    return out


def test_targets_are_capped_and_reshared(spark):
    rng = np.random.default_rng(3)
    many = {f"s{i:03d}": int(10 ** rng.uniform(0, 6)) for i in range(300)} | {None: 40, "S": 0, "\u00e9": 7, "\U0001f600": 9}
    for sizes in ({"b": 1000, None: 10, "a": 10, "c": 0}, many, {"one": 5}, {"none": 0}, {}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, [1, 2, 3], 3).collect()}
        assert got == pytest.approx(brute_targets(sizes, [1, 2, 3], 3))


def test_the_whole_mix_against_plain_python(spark):
    """Sizes, targets, budgets and the draw, all done again without Spark."""
    rng = np.random.default_rng(11)
    texts = [None if i % 97 == 0 else " ".join(["w"] * int(rng.integers(0, 30))) for i in range(700)]
    sources = [["web", "books", None, "tiny"][int(x)] if x < 3 or i % 20 == 0 else "web" for i, x in enumerate(rng.integers(0, 4, 700))]
    df = frame(spark, texts, sources=sources, clash=False)
    size = [len((t or "").split()) for t in texts]
    total = {s: sum(n for n, x in zip(size, sources) if x == s) for s in set(sources)}
    goal = brute_targets(total, [1, 2, 3], 3)
    draw = {r.doc_id: r.h for r in df.select("doc_id", F.lit(17).alias("s"), F.col("doc_id").alias("i")).join(spark.createDataFrame(list(enumerate(size)), "doc_id long, size long"), "doc_id").select("doc_id", F.xxhash64(F.lit(17), "i", "size").alias("h")).collect()}
    want = {}
    for s in total:
        ids = [i for i, x in enumerate(sources) if x == s]
        base = min(int(goal[s] // total[s]), 3) if total[s] else 0
        budget = round(goal[s]) - base * total[s] if base < 3 else 0
        lengths = sorted({size[i] for i in ids})
        counts = [sum(size[i] == n for i in ids) for n in lengths]
        extra = dict(zip(lengths, mixing.fit_counts(np.array(lengths), np.array(counts), budget).tolist()))
        for n in lengths:
            ranked = sorted((draw[i], i) for i in ids if size[i] == n)
            for place, (_, i) in enumerate(ranked):
                want[i] = base + (place < extra[n])
        assert abs(sum(want[i] * size[i] for i in ids) - goal[s]) <= 1
    assert {r.id: r.copies for r in mixing.mix(df).collect()} == want




def test_mix_of_odd_rows(odd, repeated, nothing):
    rows = mixing.mix(odd).collect()
    texts = odd_texts()
    assert {r.id: r["size"] for r in rows} == {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert sum(g[0].target for g in by.values()) == pytest.approx(total)
    for g in by.values():
        assert all(0 <= r.taken <= 3 * r["size"] and r.source_size == sum(x["size"] for x in g) for r in g)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(odd).collect()), key=repr)
    assert len(mixing.mix(repeated).collect()) == len(texts) + 5
    assert mixing.mix(nothing).count() == 0


def test_words_taken_come_near_the_targets(spark):
    texts = [prose(i, 3 + i % 50) for i in range(600)]
    sources = ["hot" if i % 3 else f"s{i % 4}" for i in range(600)]
    df = frame(spark, texts, sources=sources, clash=False)
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 1 for r in got)
    out = mixing.resample(df)
    assert out.columns == df.columns
    per = out.groupBy("doc_id").count().collect()
    want = {r.id: r.copies for r in mixing.mix(df).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in per} == want


def test_equal_lengths_are_drawn_by_hash(spark):
    df = frame(spark, [prose(i, 10) for i in range(400)], sources=["a"] * 200 + ["b"] * 200, clash=False)
    got = mixing.mix(df, weights=[1, 3]).groupBy("source").agg(F.sum("taken").alias("t"), F.min("copies").alias("lo"), F.max("copies").alias("hi")).collect()
    assert {r.source: (r.t, r.lo, r.hi) for r in got} == {"a": (1000, 0, 1), "b": (3000, 1, 2)}
    assert mixing.resample(frame(spark, [])).count() == 0
