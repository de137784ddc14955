import hashlib

import numpy as np
import pytest

from llm_helpers import frame, odd_texts, prose
from tarnflow.llm import fingerprint as fp


def brute_edited(texts):
    """By descending id: the second half replaced by the start of the next one."""
    out = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        out.append(t[: len(t) - half] + texts[i - 1][:half])  # i - 1: the next smaller id; before the first the last
    return out


def test_edited_texts(spark, odd):
    texts = [t or "" for t in odd_texts()]
    rows = sorted(fp.edited_fingerprints(odd).collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == list(range(len(texts)))
    edited = brute_edited(texts)
    assert [r.edited_sha256 for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    assert [r.n_chars for r in rows] == [len(t) for t in texts]
    own, theirs = fp.simhash_batch(texts), fp.simhash_batch(edited)
    assert [r.fingerprint for r in rows] == [x.tobytes().hex() for x in own]
    assert [r.edited_fingerprint for r in rows] == [x.tobytes().hex() for x in theirs]
    assert [r.near_edited for r in rows] == pytest.approx(fp.likeness(own, theirs).tolist())
    assert [r.near_next for r in rows] == pytest.approx(fp.likeness(own, np.roll(own, 1, axis=0)).tolist())


def test_many_ranges_and_one_row(spark, repeated, nothing):
    texts = [prose(i, 5 + i % 40) for i in range(700)]
    ids = [i * i + 3 for i in range(700)]
    rows = sorted(fp.edited_fingerprints(frame(spark, texts, ids=ids, clash=False)).collect(), key=lambda r: r.id)
    assert [r.edited_sha256 for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for t in brute_edited(texts)]
    assert all(0 <= r.near_next <= 1 for r in rows)
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95
    one = fp.edited_fingerprints(frame(spark, ["abcd"])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fp.edited_fingerprints(nothing).count() == 0
    assert len(fp.edited_fingerprints(repeated).collect()) == len(odd_texts()) + 5
    assert len(fp.edited_fingerprints(frame(spark, ["a b", "c d"], ids=[None, None])).collect()) == 2


def test_equal_texts_wherever_they_stand():
    texts = [prose(i, 30) for i in range(40)]
    alone = [fp.simhash_batch([t])[0].tobytes() for t in texts]
    assert [x.tobytes() for x in fp.simhash_batch([*texts, *texts])] == alone * 2


def test_search_finds_all_within_the_radius(spark):
    texts = [" ".join([*prose(i // 4, 80).split()[: 80 - i % 4], *["x"] * (i % 4)]) for i in range(80)] + ["", None, ""]
    prints = fp.fingerprints(frame(spark, texts))
    rows = {r.id: r.fingerprint for r in prints.collect()}
    value = {k: int(v, 16) for k, v in rows.items()}
    for radius in (0, 6, 20):
        want = {(rows[a], rows[b], (value[a] ^ value[b]).bit_count()) for a in rows for b in rows if (value[a] ^ value[b]).bit_count() <= radius}
        got = {tuple(r) for r in fp.within_radius(prints, prints, radius).collect()}
        assert got == want
    with pytest.raises(ValueError):
        fp.within_radius(prints, prints, 32)


def test_counts_within_the_radius(spark):
    texts = [" ".join([*prose(i // 4, 80).split()[: 80 - i % 4], *["x"] * (i % 4)]) for i in range(60)] + [prose(3, 80)] * 5
    ids = [*range(0, 600, 10), 1, 2, 3, None, None]
    prints = fp.fingerprints(frame(spark, texts, ids=ids))
    value = [int(r.tobytes().hex(), 16) for r in fp.simhash_batch(texts)]
    for radius in (3, 12):
        want = {i: sum((v ^ w).bit_count() <= radius for w in value) - 1 for i, v in zip(ids, value) if i is not None and i % 100 == 0}
        assert {r.id: r.n_within for r in fp.near_counts(prints, radius).collect()} == want


def test_texts_of_megabytes(spark):
    texts = [prose(1, 330_000), "a b", prose(2, 330_000)]
    rows = sorted(fp.edited_fingerprints(frame(spark, texts)).collect(), key=lambda r: r.id)
    assert [r.edited_sha256 for r in rows] == [hashlib.sha256(t.encode()).hexdigest() for t in brute_edited(texts)]
    assert [r.fingerprint for r in rows] == [x.tobytes().hex() for x in fp.simhash_batch(texts)]
