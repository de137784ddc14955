import math

import numpy as np
import pytest

from tarnflow.llm import embedding_dedup as ed


def brute(rows, threshold=0.9):
    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, head = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, (a, v) in enumerate(rows):
        for j in range(i):
            b, w = rows[j]
            if a is None or b is None or not fine(v) or not fine(w) or len(v) != len(w):
                continue
            x, y = np.array(v, np.float64), np.array(w, np.float64)
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                head[max(p, q)] = min(p, q)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            r = find(i)
            least[r] = min(least.get(r, a), a)
    return sorted(((a, n[i], None if a is None else least[find(i)]) for i, (a, _) in enumerate(rows)), key=repr)


def clusters(seed, n, dim=16, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    out = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * spread * rng.integers(0, 5, (n, 1))
    return out.astype(np.float32).tolist()


def found(spark, rows, **kw):
    df = spark.createDataFrame([(a, v, 0, "?", "?") for a, v in rows], "vec_id long, embedding array<float>, label int, id string, v string")
    return sorted((tuple(r) for r in ed.near_vectors(df, **kw).collect()), key=repr)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [0.95, 0.1]), (4, None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("block", [512, 20])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    monkeypatch.setattr(ed, "LIST", 24)
    monkeypatch.setattr(ed, "PROBES", 8)
    vectors = clusters(2, 500)
    rows = [(7 * i + 1, v) for i, v in enumerate(vectors)] + [(100_000 + i, vectors[0]) for i in range(40)]
    got, want = found(spark, rows), brute(rows)
    recall = sum(r[1] for r in got) / sum(r[1] for r in want)
    assert recall > 0.97 and all(a[1] <= b[1] for a, b in zip(got, want))
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.93


def test_codes_rule_nothing_out(spark):
    x = ed._unit(np.array(clusters(4, 600), np.float64))
    q = ed.Quantizer.fit(x, 8)
    probes, codes, off = q.encode(x)
    for list_ in range(8):
        own = np.flatnonzero(probes[:, 0] == list_)
        if len(own):
            near = np.sqrt(q.approximate(x, list_, codes[own])) - off[own][None, :]
            true = np.sqrt(((x[:, None, :] - x[own][None, :, :]) ** 2).sum(axis=2))
            assert (near <= true + 1e-6).all()


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum() - len(x)
    got = ed.near_vectors(df).groupBy().sum("n_links").head()[0]
    assert got >= 0.9 * links and got <= links


def test_extreme_numbers(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e300, 0.0]), (4, [5e-324, 0.0]), (5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ed.near_vectors(df).collect())) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5)]


def test_lists_grow_with_the_vectors():
    n = [10**k for k in range(1, 10)]
    lists = [ed.lists_for(x) for x in n]
    assert lists == sorted(lists) and lists[0] == 1 and lists[-1] > 100_000
    assert all(x / k <= 256 or x / k <= x**0.5 for x, k in zip(n, lists) if k > 1)


@pytest.mark.parametrize("size", [4_000, 40_000])
def test_recall_of_planted_links_among_many_lists(spark, size):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(size, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(500, 64))
    side -= (side * x[:500]).sum(axis=1, keepdims=True) * x[:500]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.905, 0.95, (500, 1))
    y = np.concatenate([x, cos * x[:500] + np.sqrt(1 - cos**2) * side])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(y.tolist())], "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component) for r in ed.near_vectors(df, threshold=0.9).collect()}
    right = sum(got[i] == got[size + i] == (1, i) for i in range(500))
    assert right >= 450
    assert all(got[i] == (0, i) for i in range(500, size))  # no false link
