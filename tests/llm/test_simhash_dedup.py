import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_helpers import collected, frame, odd_texts, prose
from tarnflow.llm import components, simhash_dedup as sd


def brute_fp(text, width=3):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = [w for w in lower.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_heads(fps, budget):
    head = list(range(len(fps)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= budget:
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(seed, n, spread=4):
    """Fingerprints around a few centres, so that chains and crowded nodes occur."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 40))]
    out = set()
    while len(out) < n:
        x = rng.choice(centres) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprints_against_plain_python():
    for t in odd_texts():
        assert sd.simhash_text(t or "") == brute_fp(t)
    assert sd.simhash_text("A\x0bb\x0c c") == brute_fp("a b c")


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_walk_finds_every_link(budget):
    for seed in range(4):
        x = np.array(clustered(seed, 300), np.uint64)
        zero = np.array([0])
        heads = sd._walk(x, zero, np.array([len(x)]), np.array([len(x)]), zero, zero, zero, budget)
        assert heads.tolist() == brute_heads(x, budget)


@pytest.mark.parametrize("limit", [16, 100_000])
def test_links_however_work_is_split(spark, limit):
    fps = clustered(9, 400)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = sd.trie_links(df, 3, limit).collect()
    place = {x: i for i, x in enumerate(signed)}
    head = list(range(len(fps)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for r in links:
        assert (fps[place[r.a]] ^ fps[place[r.b]]).bit_count() <= 3 * 64
        a, b = find(place[r.a]), find(place[r.b])
        head[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == brute_heads(fps, 3)
    assert len(links) <= 4 * len(fps)


def test_groups_of_odd_rows(spark, odd, repeated, nothing):
    texts = odd_texts()
    fps = [brute_fp(t) for t in texts]
    heads = brute_heads(fps, 3)
    got = collected(sd.simhash_groups(odd))
    assert got == sorted(((i, f - (1 << 64) if f >= 1 << 63 else f, h) for i, (f, h) in enumerate(zip(fps, heads))), key=repr)
    assert sd.simhash_groups(nothing).count() == 0
    again = sd.simhash_groups(repeated).collect()
    assert len(again) == len(texts) + 5
    assert sum(r.id == 0 for r in again) == 2
    assert all(r.component == heads[4] for r in again if r.id == 4)


def test_one_of_each_group_stays(spark, odd, repeated, nothing):
    kept = sd.keep_first(repeated)
    assert kept.columns == repeated.columns
    found = kept.select("doc_id", "text").collect()
    ids = [r.doc_id for r in found]
    assert sorted(x for x in ids if x is not None) == sorted({x for x in ids if x is not None})
    assert ids.count(None) == 1 and 0 in ids and 1 not in ids and 2 not in ids
    assert 14 in ids and 8 in ids
    assert [r.text for r in found if r.doc_id == 3] == ["another text of id 3"]
    assert sd.keep_first(nothing).count() == 0


def test_similar_texts_whatever_their_edits(spark):
    texts = []
    for s in range(40):
        words = prose(s + 100, 300).split()
        texts.append(" ".join(words))
        for k in (1, 3):  # each edit changes 5 shingles of 296
            w = list(words)
            for i in range(k):
                w[40 + 60 * i] = f"edit{s}{i}"
            texts.append(" ".join(w))
    got = {r.id: r.component for r in sd.similar_groups(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 3 for i in range(len(texts))]
    small = {r.id: r.component for r in sd.similar_groups(frame(spark, texts), limit=20).collect()}
    assert small == got


def test_long_fingerprints():
    a, b, c = sd.long_fingerprints([prose(1, 200), prose(1, 200).upper(), ""])
    assert (a == b).all() and not c.any()
    assert sd.bits_apart(1.0, 512) == 0 and sd.bits_apart(0.8, 512) == 78
    one, two = sd.long_fingerprints(["one two three", "one two four"])
    assert np.bitwise_count(one ^ two).sum() > 56


def jaccard(one, two, width=5):
    a, b = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (t.lower().split() for t in (one, two)))
    return len(a & b) / len(a | b)


def test_a_shared_line_makes_no_copies(spark):
    line = prose(500, 15)
    texts = [" ".join([line] * k + [prose(s + k, 64)]) for k in (10, 30) for s in (600, 700, 800)]
    assert all(jaccard(a, b) < 0.5 for i, a in enumerate(texts) for b in texts[:i])
    got = {r.id: r.component for r in sd.similar_groups(frame(spark, texts)).collect()}
    assert got == {i: i for i in range(len(texts))}
    assert sd.keep_first(frame(spark, texts)).count() == len(texts)


def edited(seed):
    """Texts of 120 words, each with copies of which 1 to 5 words, at odd distances, are changed; and their groups by brute force."""
    rng = random.Random(seed)
    texts = []
    for s in range(40):
        words = prose(s + 900, 120).split()
        texts.append(" ".join(words))
        for k in range(1, 6):
            w = list(words)
            for i in rng.sample(range(120), k):
                w[i] = f"edit{s}{k}{i}"
            texts.append(" ".join(w))
    head = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if i // 6 == j // 6 and head[i] != head[j] and jaccard(a, texts[j]) >= 0.8:
                old, new = max(head[i], head[j]), min(head[i], head[j])
                head = [new if h == old else h for h in head]
    return texts, dict(enumerate(head))


def test_links_are_those_of_brute_force(spark, monkeypatch):
    texts, want = edited(5)
    near = [jaccard(a, b) for g in range(0, len(texts), 6) for i, a in enumerate(texts[g : g + 6]) for b in texts[g : g + i]]
    assert sum(0.75 <= x < 0.8 for x in near) > 20 and sum(0.8 <= x < 0.85 for x in near) > 20
    assert {r.id: r.component for r in sd.similar_groups(frame(spark, texts)).collect()} == want
    monkeypatch.setattr(sd, "PAIRS", 0)  # hubs first
    assert {r.id: r.component for r in sd.similar_groups(frame(spark, texts)).collect()} == want


def test_links_do_not_depend_on_how_work_is_dealt(spark, monkeypatch):
    texts, want = edited(6)
    assert {r.id: r.component for r in sd.similar_groups(frame(spark, texts), limit=4).collect()} == want
    monkeypatch.setattr(sd, "CELL", 3000)  # many cells
    assert {r.id: r.component for r in sd.similar_groups(frame(spark, texts)).collect()} == want


def test_links_without_any_help_of_fingerprints(spark, monkeypatch):
    texts, want = edited(7)
    monkeypatch.setattr(sd, "_near_pairs", lambda nodes, *_: nodes.sparkSession.createDataFrame([], "a long, b long"))
    assert {r.id: r.component for r in sd.similar_groups(frame(spark, texts)).collect()} == want


def test_texts_of_megabytes(spark):
    words = prose(1, 300_000).split()
    other = " ".join(prose(2, 300_000).split())
    one, two = " ".join(words), " ".join([*words[:150_000], "changed", *words[150_001:]])
    assert len(one) > 2 << 20
    got = {r.id: r.component for r in sd.similar_groups(frame(spark, [one, other, two, "short"])).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}
    assert sd.simhash_groups(frame(spark, [one, other, two])).count() == 3


def test_rows_of_one_id_or_none_are_rows_of_their_own(spark):
    texts = [prose(1, 200), prose(2, 200), prose(3, 200), prose(3, 200) + " end", prose(4, 200)]
    kept = sd.keep_first(frame(spark, texts, ids=[7, 7, None, None, 8])).select("doc_id", "text").collect()
    assert sorted(r.text for r in kept if r.doc_id is not None) == sorted([texts[0], texts[1], texts[4]])
    assert len([r for r in kept if r.doc_id is None]) == 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), (None, 3), (30, 31), (31, 30)] + [(100, x) for x in range(101, 160)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 30: 30, 31: 30} | dict.fromkeys(range(5, 11), 5) | dict.fromkeys(range(100, 160), 100)
    assert got == want
    rng = random.Random(4)
    crowd = [(x, x + 40 * rng.randint(-1, 1)) for x in (rng.randint(40, 440) for _ in range(4000))]  # groups of one remainder
    found = {r.node: r.label for r in components.components(spark.createDataFrame(crowd, "a long, b long").repartition(7)).collect()}
    least = {}
    for x in found:
        least[x % 40] = min(least.get(x % 40, x), x)
    assert len(found) > 400 and all(found[x] == least[x % 40] for x in found)
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.components(chain).filter("label <> 0").count() == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parities_rule_out_no_pair_that_is_alike():
    texts, _ = edited(9)
    term, bounds = sd.shingle_sets(texts, 5)
    bits = sd.parities(term, bounds)
    sets = [set(term[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    out = 0
    for i in range(60):
        for j in range(i):
            differ = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            assert differ <= len(sets[i] ^ sets[j])
            out += differ * 9 > len(sets[i]) + len(sets[j])
    assert out > 1000  # most pairs are ruled out
