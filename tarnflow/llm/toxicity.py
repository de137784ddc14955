"""Toxicity by weak supervision.

1. Voters. Words and word beginnings that labelled toxic texts use much more often
   than others form the lexicon; a few patterns (capitals, exclamation marks, runs
   of one sign) vote too. Each votes "toxic" on a text or abstains.
2. Label model. Every voter fires with one rate on toxic and another on clean texts.
   The rates, the share of toxic texts and the noise of the given labels are fitted
   by expectation maximisation; correlations of voters beyond what the classes
   explain are estimated from the same posteriors, and each voter's evidence is
   divided by how many voters say the same, so echoes do not count twice.
3. Classifier. A ridge logistic regression over all lexicon terms and patterns is
   trained on the posterior labels and scores every text; its intercept is set so
   that 0.5 parts the given labels of the sample best.

The lexicon and the classifier are fitted on at most ``SAMPLE`` labelled rows (those
with the smallest hash of their id). The label model sees the votes on every row, as
counts of rows of the same votes, and every row of the table is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, cut, discard, materialize, small_batches, texts, trim
from .terms import U, Words, code_points, is_letter, is_space, mix

#: Bounds of the fit: labelled rows, lexicon terms, voters.
SAMPLE, LEXICON, VOTERS = 8000, 512, 96
#: Labelled toxic texts that must use a term before it may enter the lexicon.
SUPPORT = 3
#: Evidence (log likelihood ratio) a term must have; chance reaches about this among a million terms.
EVIDENCE = 10.0
#: A term is a whole word or its first so many characters, seen at least so often in a text.
KINDS = (None, 4, 5, 6, 7, 8)
LEVELS = (1, 2, 4)
PATTERNS = 4
#: How many toxic texts let through one clean text flagged is worth, in shares.
COST = 4.0


def terms_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term hash) of all terms of a batch, repeats included."""
    points, starts = code_points([t.lower() for t in batch])
    words = Words(points, starts, is_letter(points))
    owner, found = [], []
    for kind, prefix in enumerate(KINDS):
        h = mix(words.hashes(prefix) + U(kind + 1))
        use = np.ones(len(h), bool) if prefix is None else words.length > prefix
        owner.append(words.doc[use])
        found.append(h[use])
    return np.concatenate(owner), np.concatenate(found)


def patterns_of(batch: list[str]) -> np.ndarray:
    """(texts, PATTERNS) of 0/1: mostly capitals, many ! or ?, a run of five equal signs, one word over 40 long."""
    out = np.zeros((len(batch), PATTERNS), np.float32)
    if not batch:
        return out
    points, starts = code_points(batch)
    n = np.diff(np.append(starts, len(points))).astype(float)
    ascii_letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    upper = (points >= 65) & (points <= 90)
    add = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    letters = add(ascii_letter)
    out[:, 0] = (letters >= 10) & (add(upper) > 0.5 * letters)
    out[:, 1] = add((points == 33) | (points == 63)) > 0.01 * n
    same = np.zeros(len(points), bool)
    if len(points) > 4:
        eq = points[1:] == points[:-1]
        run = eq[:-3] & eq[1:-2] & eq[2:-1] & eq[3:]
        same[: len(run)] = run & ~is_space(points[: len(run)])
    out[:, 2] = add(same) > 0
    words = Words(points, starts, ~is_space(points))
    long_ = np.zeros(len(batch), bool)
    long_[words.doc[words.length > 40]] = True
    out[:, 3] = long_
    return out


@dataclass
class Classifier:
    """Lexicon hashes and levels, a weight for each and for each pattern, and an intercept."""

    lexicon: np.ndarray
    levels: np.ndarray
    weights: np.ndarray
    intercept: float

    def features(self, batch: list[str]) -> np.ndarray:
        x = np.zeros((len(batch), len(self.lexicon) + PATTERNS), np.float32)
        if len(self.lexicon) and batch:
            base, column = np.unique(self.lexicon, return_inverse=True)
            owner, found = terms_of(batch)
            at = np.searchsorted(base, found)
            at[at == len(base)] = 0
            hit = base[at] == found
            n = np.bincount(owner[hit] * len(base) + at[hit], minlength=len(batch) * len(base)).reshape(len(batch), len(base))
            x[:, : len(self.lexicon)] = n[:, column] >= self.levels
        x[:, len(self.lexicon) :] = patterns_of(batch)
        return x

    def score(self, batch: list[str]) -> np.ndarray:
        return _sigmoid(self.features(batch) @ self.weights + self.intercept)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class LabelModel:
    """How often each voter fires on toxic (``on``) and on clean texts (``off``), the share of toxic texts, the noise of given labels, and what each voter's evidence counts for."""

    on: np.ndarray
    off: np.ndarray
    prior: float
    noise: float
    weight: np.ndarray

    def posterior(self, votes: np.ndarray, gold: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of ``votes`` (0/1, one column per voter), with ``gold`` 0, 1 or -1 (none given)."""
        z = np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * np.log(self.on / self.off))  # who abstains says nothing
        return _sigmoid(z + np.where(gold >= 0, np.where(gold == 1, 1, -1) * np.log((1 - self.noise) / self.noise), 0))


def _moments(votes: np.ndarray, gold: np.ndarray, count: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Sums over rows that one round of the fit needs; they add up over parts of a table."""
    known = (gold >= 0) * count
    wrong = np.where(gold == 1, 1 - post, post) * known
    return np.concatenate([votes.T @ (count * post), [count.sum(), (count * post).sum(), (count * post * post).sum(), known.sum(), wrong.sum()]])


def label_model(total: Callable[[LabelModel | None], np.ndarray], fired: np.ndarray, fired_known: np.ndarray, both_known: np.ndarray, prior: float, rounds: int = 15) -> LabelModel:
    """Expectation maximisation over a table of votes that only ``total`` sees.

    ``total(model)`` gives the ``_moments`` of all rows under a model, and under None
    those of the rows with a given label, which is then believed: the start. On those
    rows the voters' correlations are measured, as elsewhere classes are not certain
    enough to tell an echo from a class. ``fired`` and ``fired_known`` say on how many
    rows (of all, of the labelled) a voter fires, ``both_known`` two voters. Given
    labels are one more, rather accurate voter whose noise is estimated too. Their
    share of "toxic" is the prior: as who abstains says nothing, the rows could not
    hold a fitted one back.
    """
    n = len(fired)
    x = total(None)
    on_sum, (size, p, p2, _, _) = x[:n], x[n:]
    on, off = (on_sum + 0.5) / (p + 1), (fired_known - on_sum + 0.5) / (size - p + 1)
    model = LabelModel(on, off, prior, 0.02, 1 / _echo(on_sum, fired_known, both_known, size, p, p2, on, off))
    for _ in range(rounds):
        x = total(model)
        on_sum, (size, p, _, known, wrong) = x[:n], x[n:]
        on, off = (on_sum + 0.5) / (p + 1), (fired - on_sum + 0.5) / (size - p + 1)
        noise = float(np.clip(wrong / known, 0.005, 0.2)) if known else model.noise
        moved = max(np.abs(np.log(on / model.on)).max(initial=0), np.abs(np.log(off / model.off)).max(initial=0), abs(noise - model.noise))
        model = LabelModel(on, off, prior, noise, model.weight)
        if moved < 1e-3:
            break
    return model


def _echo(on_sum: np.ndarray, fired: np.ndarray, both: np.ndarray, size: float, p: float, p2: float, on: np.ndarray, off: np.ndarray) -> np.ndarray:
    """1 + the sum of each voter's correlations to others within the classes (small ones are noise and left out).

    A row's votes are expected at ``off + post * (on - off)``; the products of what
    they are off by, summed over rows, follow from sums alone.
    """
    d = on - off
    cross = np.outer(fired, off) + np.outer(on_sum, d)
    cov = both - cross - cross.T + size * np.outer(off, off) + p * (np.outer(off, d) + np.outer(d, off)) + p2 * np.outer(d, d)
    cov = cov / max(1.0, size)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = cov / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    return 1 + np.where(corr > 0.2, corr, 0).sum(axis=1)


def _bits(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of up to 126 votes as two whole numbers."""
    power = np.left_shift(np.int64(1), np.arange(63, dtype=np.int64))
    v = votes.astype(np.int64)
    return v[:, :63] @ power[: min(63, v.shape[1])], v[:, 63:] @ power[: max(0, v.shape[1] - 63)]


def _unbits(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    at = np.arange(63, dtype=np.int64)
    return np.hstack([(low[:, None] >> at) & 1, (high[:, None] >> at) & 1])[:, :n].astype(float)


def _patterns(docs: DataFrame, given: DataFrame, blank: Classifier, voters: np.ndarray) -> DataFrame:
    """``(low, high, y, n)``: how many texts of ``docs(id, text)`` have which votes and given label (-1: none); copies of a text count once."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            low, high = _bits(blank.features(texts(b.column(1)))[:, voters] > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(low), pa.array(high)], names=["id", "copy", "low", "high"])
        trim()

    seen = docs.select("id", "text", F.xxhash64("text").alias("copy")).mapInArrow(look, "id long, copy long, low long, high long")
    seen = seen.join(given.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left")
    seen = seen.groupBy("copy").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max(F.coalesce("y", F.lit(-1))).alias("y"))
    return materialize(seen.groupBy("low", "high", "y").agg(F.count("*").alias("n")), "patterns")


def _fitted(patterns: DataFrame, n: int) -> LabelModel:
    """The label model of all rows behind ``patterns``, some of which have a label; a round is one pass over them, a row of sums for each task."""

    def summed(make: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = 0
            for b in batches:
                low, high, y, count = (c.to_numpy() for c in b.columns)
                for i in range(0, len(low), 8192):
                    s = slice(i, i + 8192)
                    out = out + make(_unbits(low[s], high[s], n), y[s], count[s].astype(float))
            if not np.isscalar(out):
                yield pa.RecordBatch.from_arrays([pa.array([out.astype(float).tobytes()], pa.binary())], names=["sums"])

        return sum((np.frombuffer(r.sums) for r in patterns.mapInArrow(run, "sums binary").collect()), np.zeros(1))

    def counts(v: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
        known = v * (c * (y >= 0))[:, None]
        return np.concatenate([[((y == 1) * c).sum(), ((y >= 0) * c).sum()], (v * c[:, None]).sum(axis=0), known.sum(axis=0), (known.T @ v).ravel()])

    start = summed(counts)
    prior = float(np.clip(start[0] / start[1], 0.01, 0.99))
    believed = lambda y: np.where(y == 1, 0.95, 0.02)
    moments = lambda model: summed(lambda v, y, c: _moments(v, y, c * (y >= 0), believed(y)) if model is None else _moments(v, y, c, model.posterior(v, y)))
    return label_model(moments, start[2 : 2 + n], start[2 + n : 2 + 2 * n], start[2 + 2 * n :].reshape(n, n), prior)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Newton's method, with steps halved until they help; the intercept is hardly penalised."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(mean / (1 - mean))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        grad = x.T @ (y - p) - penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, grad)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        before, now = now, min(now, loss(w + size * step))
        w = w + size * step
        if before - now < 1e-6 * max(1.0, now):
            break
    return w[:-1], float(w[-1])


def _border(z: np.ndarray, gold: np.ndarray) -> float:
    """The score that parts given labels best: the middle of the gap with the most right minus ``COST`` times wrong shares."""
    pos, neg = np.sort(z[gold == 1]), np.sort(z[gold == 0])
    if not len(pos) or not len(neg):
        return 0.0
    edges = np.unique(np.concatenate([pos, neg]))
    if len(edges) < 2:
        return 0.0
    mid = (edges[1:] + edges[:-1]) / 2
    gain = (1 - np.searchsorted(pos, mid) / len(pos)) - COST * (1 - np.searchsorted(neg, mid) / len(neg))
    return float(mid[gain == gain.max()].mean())


def _sample(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, those with the smallest hash of the id."""
    n = rows.count()
    h = F.xxhash64(F.lit(5), id_col)
    if n > bound:  # far fewer rows have to be ordered
        share = min(1.0, 1.1 * bound / n)
        rows = rows.filter(h < F.lit(int(-(1 << 63) + share * ((1 << 64) - 1024))))
    return rows.orderBy(h, id_col).limit(bound)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Classifier:
    """Learn from ``labels(id, label 0/1)`` and the texts of ``docs``; other label values are ignored.

    Lexicon and classifier are fitted on at most ``sample`` labelled rows; the label
    model counts the votes on all rows, labelled or not.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    given = materialize(given, "given")
    some = materialize(_sample(given, "id", sample).coalesce(1), "sample")
    # at most ``sample`` rows, so it is broadcast
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = base.join(F.broadcast(some), "id").groupBy(F.xxhash64("text").alias("copy")).agg(F.min(F.struct("id", "y", "text")).alias("r")).select("r.*")
    held = materialize(held, "held")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            y = np.array(b.column(1).to_pylist())
            owner, found = terms_of(texts(b.column(2)))
            pair = mix(found + mix(owner.astype(U)))
            _, at, n = np.unique(pair, return_index=True, return_counts=True)
            for level in LEVELS:
                often = at[n >= level]
                term, label = found[often], y[owner[often]]
                names, place = np.unique(term, return_inverse=True)
                pos = np.bincount(place, weights=label == 1, minlength=len(names)).astype(np.int64)
                neg = np.bincount(place, weights=label == 0, minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.full(len(names), level, np.int32)), pa.array(pos), pa.array(neg)], names=["term", "level", "pos", "neg"])

    sizes = {r.y: r.n for r in held.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        share = (n_pos + 0.5) / (n_pos + n_neg + 1) if n_pos + n_neg else 0.0
        return Classifier(np.zeros(0, U), np.zeros(0, np.int32), np.zeros(PATTERNS), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    counted = held.mapInArrow(count, "term long, level int, pos long, neg long").groupBy("term", "level").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = F.col("pos") + F.col("neg")
    share = n_pos / (n_pos + n_neg)
    gain = lambda n, part: F.when(n > 0, n * F.log(n / (total * part))).otherwise(0.0)
    strength = gain(F.col("pos"), share) + gain(F.col("neg"), 1 - share)
    top = counted.filter((F.col("pos") >= SUPPORT) & (F.col("pos") * n_neg > 4 * F.col("neg") * n_pos)).withColumn("z", strength)
    rows = top.filter(F.col("z") >= EVIDENCE).orderBy(F.desc("z"), "term", "level").limit(LEXICON).collect()
    terms = np.array([r.term for r in rows], np.int64).view(U)
    levels = np.array([r.level for r in rows], np.int32)
    blank = Classifier(terms, levels, np.zeros(0), 0.0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            x = blank.features(texts(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.flatnonzero(r) for r in x], pa.list_(pa.int64()))], names=["id", "y", "on"])

    seen = held.mapInArrow(look, "id long, y int, on array<long>").orderBy("id").collect()
    x = np.zeros((len(seen), len(terms) + PATTERNS), np.float32)
    for i, r in enumerate(seen):
        x[i, r.on] = 1
    gold = np.array([r.y for r in seen])
    voters = np.concatenate([np.arange(min(VOTERS, len(terms))), len(terms) + np.arange(PATTERNS)])
    patterns = _patterns(base, given, blank, voters)
    post = _fitted(patterns, len(voters)).posterior(x[:, voters].astype(np.float64), gold)
    discard(patterns)
    weights, intercept = _logistic(x, post)
    intercept -= _border(x @ weights + intercept, gold)
    return Classifier(terms, levels, weights, intercept)


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row; null texts count as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            s = model.score(texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, score double")


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row.

    Labels are learnt from all folds (crc32 of the id as text, modulo ``folds``) but
    one; rows without an id are never learnt from. Without labels of both kinds every
    score is the same. Empty and null texts get the score of a text without any vote,
    repeated rows each get theirs, an empty table gives no rows, extra columns are
    not read. A text is never cut, however long.
    """
    kept = labels.filter(crc_bucket(F.col(id_col), folds) != held_out)
    model = fit(docs.filter(crc_bucket(F.col(id_col), folds) != held_out), kept, id_col, text_col)
    out = score(docs, model, id_col, text_col)
    return out.select("id", (crc_bucket(F.col("id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``limit``; all their columns, clashing names included; texts are not shuffled.

    Null and empty texts stay unless a text without any vote is flagged; repeated rows
    and rows without an id are judged each by its own text; an empty table gives no rows.
    """
    kept = labels.filter(crc_bucket(F.col(id_col), 5) != 0)
    model = fit(docs.filter(crc_bucket(F.col(id_col), 5) != 0), kept, id_col, text_col)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            yield b.filter(pa.array(model.score(texts(b.column(at))) < limit))
        trim()

    return docs.mapInArrow(run, docs.schema)
