import hashlib
import random

import numpy as np
import pytest

from llm_helpers import collected, frame, odd_texts, prose
from tarnflow.llm import suffix_dedup as sx


def brute(texts, length=100):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            else:
                seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shared_passages(seed, n):
    """Texts that share passages of all lengths, also cut, shifted and repeated within one."""
    rng = random.Random(seed)
    pool = [prose(seed * 50 + i, rng.randint(5, 60)) for i in range(8)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool) if rng.random() < 0.6 else prose(1000 + seed * n + i, rng.randint(1, 30))
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a : len(p) - rng.randint(0, len(p) // 3)])
        out.append(rng.choice([" ", "", "\n"]).join(parts))
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_against_every_window(spark, hot):
    texts = shared_passages(1, 120) + ["ab" * 200, "ab" * 160, "a" * 99, "a" * 100, "a" * 101, "ü" * 90]
    got = [tuple(r)[1:] for r in sorted(sx.repeats(frame(spark, texts), hot=hot).collect(), key=lambda r: r.id)]
    assert got == brute(texts)


def test_odd_rows(spark, odd, repeated, nothing):
    texts = odd_texts()
    got = sorted(sx.repeats(odd).collect(), key=lambda r: r.id)
    assert [tuple(r)[1:] for r in got] == brute(texts)
    assert sx.repeats(nothing).count() == 0
    again = sx.repeats(repeated).collect()
    assert len(again) == len(texts) + 5
    zero = sorted((r.n_bytes - r.n_removed for r in again if r.id == 0), reverse=True)
    assert zero == [len(texts[0]), 0]


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(0)
    passage = rng.integers(97, 123, 300).astype(np.uint8)
    found = []
    for pad in (0, 17, 250):
        text = np.concatenate([rng.integers(97, 123, pad).astype(np.uint8), passage, rng.integers(97, 123, 40).astype(np.uint8)])
        h, c, k, p, lo, hi = sx.anchors(text)
        assert (lo[1:] == hi[:-1] + 1).all() and lo[0] == 0 and hi[-1] == len(text) - 100
        assert ((lo <= p) & (p + 32 <= lo + 100)).all() and (p >= hi).all()
        covered = {}
        for a, b, place, value in zip(lo, hi, p, h):
            for i in range(a, b + 1):
                if pad <= i <= pad + 200:
                    covered[i - pad] = (place - i, value)
        found.append(covered)
    assert found[0] == found[1] == found[2]


def test_suffix_sort_is_that_of_the_bytes():
    rng = random.Random(3)
    raw = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    group = np.sort(np.array([rng.randint(0, 30) for _ in raw]))
    s = sx.SuffixSort(*sx._rows_of(raw, 40), group)
    want = sorted(range(len(raw)), key=lambda i: (group[i], raw[i], i))
    assert s.order.tolist() == want
    for i in range(1, len(raw)):
        a, b = raw[want[i - 1]], raw[want[i]]
        if group[want[i - 1]] != group[want[i]]:
            assert s.common[i] == -1
        else:
            assert s.common[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_collisions_fall_back_on_bytes(monkeypatch):
    raw = [b"abc", b"abd", b"aaa", b"zzz", b"abc"]
    monkeypatch.setattr(sx, "_hash_rows", lambda x, base=0: np.zeros((len(x), x.shape[1] + 1), np.uint64))
    s = sx.SuffixSort(*sx._rows_of(raw, 3), np.zeros(5, np.int64))
    assert [raw[i] for i in s.order] == sorted(raw)
    assert s.common.tolist() == [-1, 1, 3, 2, 0]


def test_stripped_texts(spark, odd, nothing):
    texts = shared_passages(2, 60)
    df = frame(spark, texts)
    out = sx.strip_repeats(df)
    assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    got = {r.doc_id: (r.text, r.n_chars, r.label) for r in out.collect()}
    for i, (n, gone, _, digest) in enumerate(brute(texts)):
        text, chars, label = got[i]
        assert hashlib.sha256(text.encode()).hexdigest() == digest and chars == len(text) and label == "?"
    assert {r.doc_id: r.text for r in sx.strip_repeats(odd).collect()}[4] is None
    assert sx.strip_repeats(nothing).count() == 0
    assert collected(sx.strip_repeats(nothing)) == []


def test_contexts_of_one_hash_stay_apart():
    """Were the first hash of two contexts the same, the second would still part them."""
    h, c = np.array([7, 7, 7], np.uint64), np.array([5, 5, 5], np.uint64)
    k, doc, at = np.array([1, 2, 1], np.uint64), np.arange(3), np.zeros(3, np.int32)
    cols, first = sx._firsts([h, c, k, doc, at, at, at])
    assert cols[3].tolist() == [0, 2, 1] and first.tolist() == [True, False, True]
    one, two = (np.frombuffer(prose(s, 40).encode(), np.uint8) for s in (1, 2))
    assert not set(sx.anchors(one)[2].tolist()) & set(sx.anchors(two)[2].tolist())


def test_stretches_of_a_long_text_have_its_windows():
    data = np.frombuffer((prose(3, 300) + prose(3, 200)).encode(), np.uint8)
    whole = sx.anchors(data)
    for stretch in (1, 7, 150, 1000):
        h, c, k, p, lo, hi = sx.anchors(data, stretch=stretch)
        at = {i: (int(x), int(q)) for x, q, a, b in zip(h, p, lo, hi) for i in range(a, b + 1)}
        assert len(at) == int((hi - lo + 1).sum()) == len(data) - 99
        assert at == {i: (int(x), int(q)) for x, q, a, b in zip(whole[0], whole[3], whole[4], whole[5]) for i in range(a, b + 1)}


def test_texts_of_megabytes(spark):
    """Longer than a stretch: a second copy goes but for its first window's worth, a shared half goes, the rest stays."""
    one, two = prose(1, 330_000), prose(2, 330_000)
    texts = [one, two + one[: len(one) // 2], "short", one]
    got = sorted(sx.repeats(frame(spark, texts)).collect(), key=lambda r: r.id)
    half = len(one) // 2
    alone = [sx.repeats(frame(spark, [t])).head().n_removed for t in (one, two)]
    assert len(one) > 2 * sx.STRETCH
    assert got[3].n_removed == len(one) and got[3].n_spans == 1
    assert half <= got[1].n_removed <= half + alone[1] + 20_000 and got[0].n_removed == alone[0]
