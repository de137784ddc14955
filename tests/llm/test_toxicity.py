import zlib

import numpy as np

from llm_helpers import frame, odd_texts, prose
from tarnflow.llm import toxicity as tx

BAD = ["nastyword", "vileword", "stemmaxx", "stemmayy", "stemmazz"]


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    texts, toxic = [], []
    for i in range(n):
        words = prose(seed * n + i, 60).split()
        bad = i % 6 == 0
        if bad:
            for w in rng.choice(BAD, 4):
                words[int(rng.integers(0, len(words)))] = str(w)
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def labels(spark, toxic, ids=None):
    rows = [(i, 1, t, "?") for i, t in enumerate(toxic)] if ids is None else [(i, 1, t, "?") for i, t in zip(ids, toxic)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, y string")


def test_held_out_rows_are_told(spark):
    texts, toxic = corpus(900)
    rows = tx.judge(frame(spark, texts), labels(spark, toxic)).collect()
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(900)}
    assert all(r.held_out == fold[r.id] and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    pos, neg = [r.score for r in held if toxic[r.id]], [r.score for r in held if not toxic[r.id]]
    assert np.mean(np.array(pos)[:, None] > np.array(neg)[None, :]) > 0.98
    assert np.mean([r.predicted == toxic[r.id] for r in held]) > 0.95
    kept = tx.drop_toxic(frame(spark, texts), labels(spark, toxic))
    assert kept.columns == frame(spark, texts).columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(i in ids) != bool(t) for i, t in enumerate(toxic)]) > 0.95
    assert all(i in ids for i, t in enumerate(toxic) if not t)


def test_labels_of_held_out_rows_are_not_looked_at(spark):
    texts, toxic = corpus(200)
    lie = [1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t for i, t in enumerate(toxic)]
    a = sorted(map(tuple, tx.judge(frame(spark, texts), labels(spark, toxic)).collect()))
    assert a == sorted(map(tuple, tx.judge(frame(spark, texts), labels(spark, lie)).collect()))


def test_odd_rows(spark, odd, repeated, nothing):
    none = labels(spark, [])
    rows = tx.judge(odd, none).collect()
    assert len(rows) == len(odd_texts()) and len({r.score for r in rows}) == 1 and rows[0].predicted == 0
    one_kind = tx.judge(odd, labels(spark, [0] * 10)).collect()
    assert {r.predicted for r in one_kind} == {0}
    mixed = labels(spark, [1, 0, None, 0, 1, 7, 0, 1, 0, 0], ids=[0, 1, 2, 3, 4, 5, 6, 6, None, 999])
    assert len(tx.judge(repeated, mixed).collect()) == len(odd_texts()) + 5
    assert tx.judge(nothing, none).count() == 0
    assert tx.drop_toxic(nothing, none).count() == 0


def plain_label_model(votes, gold, rounds=15):
    """The same fit row by row, with the correlations taken from the labelled rows themselves."""
    prior, noise, known = gold[gold >= 0].mean(), 0.02, gold >= 0
    v, post = votes[known], np.where(gold[known] == 1, 0.95, 0.02)
    for i in range(rounds + 1):
        on, off = (v.T @ post + 0.5) / (post.sum() + 1), (v.T @ (1 - post) + 0.5) / ((1 - post).sum() + 1)
        if not i:
            centred = v - post[:, None] * on - (1 - post)[:, None] * off
            cov = centred.T @ centred / len(v)
            corr = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(axis=1))
        model = tx.LabelModel(on, off, prior, noise, weight)
        v, post = votes, model.posterior(votes, gold)
        noise = float(np.clip(np.where(gold == 1, 1 - post, post)[known].mean(), 0.005, 0.2))
    return model


def test_label_model_weighs_voters_and_echoes(spark):
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.3
    good = [(np.where(y, rng.random(3000) < 0.6, rng.random(3000) < 0.01)) for _ in range(6)]
    rare = [(np.where(y, rng.random(3000) < 0.1, rng.random(3000) < 0.0005)) for _ in range(60)]
    noise = rng.random(3000) < 0.2
    votes = np.array([*good, noise, noise, noise, *rare]).T.astype(float)
    gold = np.where(np.arange(3000) < 900, y, -1).astype(int)
    low, high = tx._bits(votes > 0)
    assert (tx._unbits(low, high, votes.shape[1]) == votes).all()
    df = spark.createDataFrame(list(zip(low.tolist(), high.tolist(), gold.tolist(), [1] * 3000)), "low long, high long, y int, n long")
    model = tx._fitted(df.repartition(5), votes.shape[1])
    assert np.mean((model.posterior(votes, gold) > 0.5) == y) > 0.9
    echo = 1 / model.weight
    assert (echo[6:9] > 2.9).all() and (echo[:6] < 1.2).all()
    plain = plain_label_model(votes, gold)
    assert np.allclose(model.on, plain.on, atol=0.01) and np.allclose(model.off, plain.off, atol=0.01) and np.allclose(model.weight, plain.weight, atol=1e-6)


def test_patterns():
    got = tx.patterns_of(["THIS IS ALL LOUD", "what!! ever!!", "aaaaaaa b", "x" * 41, "plain text", ""])
    assert got.tolist() == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 1, 1], [0, 0, 0, 0], [0, 0, 0, 0]]


def plain_terms(t):
    """How often a text has each term: words, and beginnings of longer words, of letters in lower case."""
    out, word = {}, ""
    for c in t.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            for kind, n in enumerate(tx.KINDS):
                if n is None or len(word) > n:
                    key = (kind, word if n is None else word[:n])
                    out[key] = out.get(key, 0) + 1
            word = ""
    return out


def test_lexicon_and_scores_against_plain_python(spark):
    texts, toxic = corpus(300, seed=4)
    learn = [zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300)]
    df, given = frame(spark, texts), labels(spark, toxic)
    model = tx.fit(df.filter("crc32(cast(doc_id as string)) % 5 <> 0"), given.filter("crc32(cast(doc_id as string)) % 5 <> 0"))
    counts = [plain_terms(t) for t in texts]
    names = {}
    for c in counts:
        for kind, piece in c:
            if (kind, piece) not in names:
                word = piece if tx.KINDS[kind] is None else piece + "q"
                owner, found = tx.terms_of([word])
                names[kind, piece] = int(found[sum(n is None or len(word) > n for n in tx.KINDS[: kind + 1]) - 1])
    rows, n_pos, n_neg = {}, sum(t for t, u in zip(toxic, learn) if u), sum(1 - t for t, u in zip(toxic, learn) if u)
    for c, t, use in zip(counts, toxic, learn):
        if use:
            for key, n in c.items():
                for level in tx.LEVELS:
                    if n >= level:
                        rows.setdefault((names[key], level), [0, 0])[1 - t] += 1
    share = n_pos / (n_pos + n_neg)
    gain = lambda n, total, part: n * np.log(n / (total * part)) if n else 0.0
    want = set()
    for (term, level), (pos, neg) in rows.items():
        z = gain(pos, pos + neg, share) + gain(neg, pos + neg, 1 - share)
        if pos >= tx.SUPPORT and pos * n_neg > 4 * neg * n_pos and z >= tx.EVIDENCE:
            want.add((term, level))
    assert {(int(a), int(b)) for a, b in zip(model.lexicon, model.levels)} == want and 0 < len(want) < tx.LEXICON
    got = {r.id: r.score for r in tx.judge(df, given).collect()}
    by_hash = [{names[k]: n for k, n in c.items()} for c in counts]
    for i, c in enumerate(by_hash):
        z = model.intercept + sum(w for a, b, w in zip(model.lexicon, model.levels, model.weights) if c.get(int(a), 0) >= b)
        z += float(tx.patterns_of([texts[i]])[0] @ model.weights[len(model.lexicon) :])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-6

