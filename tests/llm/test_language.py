import zlib

import numpy as np

from llm_helpers import frame, odd_texts, prose
from tarnflow.llm import language

#: Syllables of made-up languages.
SYLLABLES = {"aa": "ka lo mi ta re su".split(), "bb": "sch ung ein ver lich en".split(), "cc": "ción ado que men ar es".split()}


def text(lang, seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


def test_held_out_languages_are_told(spark):
    langs = [list(SYLLABLES)[i % 3] for i in range(240)]
    texts = [text(g, i, 40) for i, g in enumerate(langs)]
    rows = language.identify(frame(spark, texts, langs=langs)).collect()
    fold = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(240)}
    assert all(r.held_out == fold[r.id] for r in rows)
    assert np.mean([r.lang_pred == langs[r.id] for r in rows if r.held_out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd, repeated, nothing):
    texts = odd_texts()
    rows = {r.id: r for r in language.identify(odd).collect()}
    for i, t in enumerate(texts):
        has = any(c.isalpha() for c in t or "")
        assert rows[i].lang_pred == ("en" if has else "und") and (rows[i].score > 0) == has
    assert language.identify(nothing).count() == 0
    assert len(language.identify(repeated).collect()) == len(texts) + 5
    none = frame(spark, ["abc", "def"], langs=[None, None])
    assert {r.lang_pred for r in language.identify(none).collect()} == {"und"}


def test_counts_are_those_of_the_letters():
    grams, counts, has = language.gram_counts(["Ab, ab!", "", "x"])
    got = {("".join(map(chr, g)), int(c)) for g, c in zip(grams, counts[0]) if c}
    assert got == {("ab ", 2), ("b a", 1), (" ab", 1)} and has.tolist() == [True, False, True]


def test_batches_that_need_too_large_a_matrix(monkeypatch):
    batch = [prose(i, 50) for i in range(9)]
    whole, has = language._Bundler()(batch)
    monkeypatch.setattr(language, "CELLS", 500)
    monkeypatch.setattr(language._Bundler, "KEPT", 64)
    parts, same = language._Bundler()(batch)
    assert np.allclose(whole, parts) and (has == same).all()


def test_bound_vectors_are_nearly_orthogonal():
    v = language.gram_vectors(np.array([[97, 98, 99], [99, 98, 97], [97, 98, 100]])).astype(int)
    assert (np.abs(v @ v.T / language.DIM - np.eye(3)) < 0.15).all()


def plain_profiles(texts, langs, learn):
    """Names and scores of all texts by loops over letters, with the operator's letter vectors alone."""

    def bundled(t):
        out, run = np.zeros(language.DIM), []
        for c in [*(t or "").lower(), "\n"]:
            if c.isalpha():
                run.append(c)
            elif run and run[-1] != " ":
                run.append(" ")
        for i in range(len(run) - 2):
            v = np.ones(language.DIM)
            for k in range(3):
                v *= np.roll(language.letter_vectors(np.array([ord(run[i + k])], np.uint32))[0], k)
            out += v
        return out, any(c.isalpha() for c in t or "")

    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    made = [bundled(t) for t in texts]
    sums = {}
    for (v, has), g, use in zip(made, langs, learn):
        if use and g is not None and has:
            sums[g] = sums.get(g, 0) + unit(v)
    names = sorted(sums)
    vectors = [unit(sums[n]) for n in names]
    common = np.mean(vectors, axis=0)
    vectors = [unit(v - common) for v in vectors]
    out = []
    for v, has in made:
        cos = np.array([unit(unit(v) - common) @ w for w in vectors])
        e = np.exp(language.SHARP * (cos - cos.max()))
        out.append((names[int(cos.argmax())], 1 / e.sum()) if has else ("und", 0.0))
    return out


def test_predictions_against_plain_python(spark):
    langs = [[*SYLLABLES, None][i % 4] for i in range(90)]
    texts = [text(g or "aa", i, 3 + i % 30) for i, g in enumerate(langs)] + ["", None, "42 !", "x", "Ünï ção", "ka lo sch ung"]
    langs += ["aa", "bb", "cc", "aa", None, "bb"]
    want = plain_profiles(texts, langs, [zlib.crc32(str(i).encode()) % 4 != 2 for i in range(len(texts))])
    got = {r.id: r for r in language.identify(frame(spark, texts, langs=langs)).collect()}
    for i, (name, score) in enumerate(want):
        assert (got[i].lang_pred, round(got[i].score, 6)) == (name, round(score, 6)), texts[i]

