"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of n letters is bound into
one vector: the product of the letters' vectors, each permuted (rolled) by its
place. A text's vector bundles (sums) those of its n-grams, a language's those of
its texts. The language whose prototype has the largest cosine to the text's
vector is predicted; what all languages have in common is taken off first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, cut, small_batches, texts
from .terms import U, code_points, is_letter, mix

#: Components of a vector, letters of an n-gram, how strongly a lead in cosine speaks.
DIM, GRAM, SHARP = 1024, 3, 10.0


def letter_vectors(letters: np.ndarray, dim: int = DIM, seed: int = 7) -> np.ndarray:
    """One row of +1/-1 per code point; the same code point has the same row everywhere."""
    words = dim // 64
    x = mix(letters.astype(U)[:, None] * U(words) + np.arange(words, dtype=U)[None, :] + U(seed << 40))
    return 2 * np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1).astype(np.int8) - 1


def gram_vectors(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """``grams`` (n, GRAM) code points to their bound vectors (n, dim)."""
    alphabet, at = np.unique(grams, return_inverse=True)
    vectors = letter_vectors(alphabet, dim)
    at = at.reshape(grams.shape)
    out = np.ones((len(grams), dim), np.int8)
    for i in range(grams.shape[1]):
        out *= np.roll(vectors, i, axis=1)[at[:, i]]
    return out


#: Cells of a count matrix; a batch that needs more is halved.
CELLS = 1 << 23


def gram_counts(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Distinct n-grams (n, GRAM) of a batch, a count matrix (texts, n), and which texts have a letter.

    Letters are lower-cased; whatever is not a letter is one blank, and runs of blanks are one.
    None if the matrix of several texts would be too large.
    """
    points, starts = code_points([t.lower() for t in batch])
    letter = is_letter(points)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    doc = np.repeat(np.arange(len(batch)), np.diff(np.append(starts, len(points))))
    has = np.bincount(doc[letter], minlength=len(batch)) > 0
    points = np.where(letter, points, 32)[keep]
    doc = doc[keep]
    if len(points) < GRAM:
        return np.zeros((0, GRAM), np.uint32), np.zeros((len(batch), 0), np.float32), has
    alphabet = np.flatnonzero(np.bincount(points))
    rank = np.zeros(int(alphabet[-1]) + 1, np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    r = rank[points]
    k = len(alphabet)
    n = len(r) - GRAM + 1
    code = np.zeros(n, np.int64)
    for i in range(GRAM):
        code = code * k + r[i : i + n]
    same = doc[:n] == doc[GRAM - 1 :]
    code, owner = code[same], doc[:n][same]
    if k**GRAM <= 1 << 24:
        used = np.zeros(k**GRAM, bool)
        used[code] = True
        grams = np.flatnonzero(used)
        place = np.zeros(k**GRAM, np.int32)
        place[grams] = np.arange(len(grams), dtype=np.int32)
        at = place[code]
    else:
        grams, at = np.unique(code, return_inverse=True)
    if len(batch) > 1 and len(batch) * len(grams) > CELLS:
        return None
    counts = np.bincount(owner * len(grams) + at, minlength=len(batch) * len(grams)).reshape(len(batch), len(grams)).astype(np.float32)
    letters = np.empty((len(grams), GRAM), np.uint32)
    left = grams
    for i in range(GRAM - 1, -1, -1):
        letters[:, i] = alphabet[left % k]
        left = left // k
    return letters, counts, has


class _Bundler:
    """Bundles texts; the vectors of n-grams met before are kept, up to a bound."""

    KEPT = 1 << 14

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.vectors = np.zeros((0, DIM), np.float32)

    def __call__(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = gram_counts(batch)
        if got is None:
            half = len(batch) // 2
            parts = [self(batch[:half]), self(batch[half:])]
            return np.concatenate([x for x, _ in parts]), np.concatenate([h for _, h in parts])
        grams, counts, has = got
        if len(self.place) + len(grams) > self.KEPT:
            self.__init__()
        if len(grams) > self.KEPT:  # too many to keep: bundled a slice at a time
            slices = [slice(i, i + self.KEPT) for i in range(0, len(grams), self.KEPT)]
            return sum(counts[:, s] @ gram_vectors(grams[s]).astype(np.float32) for s in slices), has
        keys = [g.tobytes() for g in grams]
        new = [i for i, k in enumerate(keys) if k not in self.place]
        if new:
            for i in new:
                self.place[keys[i]] = len(self.place)
            self.vectors = np.concatenate([self.vectors, gram_vectors(grams[new]).astype(np.float32)])
        at = np.array([self.place[k] for k in keys], np.int64)
        return counts @ self.vectors[at] if len(at) else np.zeros((len(batch), DIM), np.float32), has


def _rows(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    return cut(batches, rows)


@dataclass
class Profiles:
    """Language names and their prototypes; ``predict`` gives the name and a score for each text."""

    names: list[str]
    vectors: np.ndarray
    common: np.ndarray

    def predict(self, bundled: np.ndarray, has: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(bundled)
        if not self.names:
            return ["und"] * n, np.zeros(n)
        x = _unit(_unit(bundled.astype(np.float64)) - self.common)
        cosine = x @ self.vectors.T
        best = cosine.argmax(axis=1)
        lead = np.exp(SHARP * (cosine - cosine.max(axis=1, keepdims=True)))
        score = np.where(has, 1.0 / lead.sum(axis=1), 0.0)
        return [self.names[b] if h else "und" for b, h in zip(best, has, strict=True)], score


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Prototypes from all rows with a language and a letter. One vector per language and task is summed."""
    spark = labelled.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, sums, seen = _Bundler(), {}, {}
        for b in _rows(batches):
            x, has = bundle(texts(b.column(0)))
            lang = np.array(b.column(1).to_pylist(), object)
            x = _unit(x.astype(np.float64))
            for name in set(lang[has]):
                own = has & (lang == name)
                sums[name] = sums.get(name, 0) + x[own].sum(axis=0)
                seen[name] = seen.get(name, 0) + int(own.sum())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(seen.values()), pa.int64()), pa.array([v for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "n", "v"])

    parts = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, F.col(lang_col).cast("string")).mapInArrow(run, "lang string, n long, v array<double>")
    got = parts.select("lang", "n", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = sorted(got.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect(), key=lambda r: r.lang)
    names = [r.lang for r in rows]
    vectors = _unit(np.array([[p.x for p in r.v] for r in rows], np.float64).reshape(len(rows), DIM))
    common = vectors.mean(axis=0) if len(rows) > 1 else np.zeros(DIM)
    return Profiles(names, _unit(vectors - common), common)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` of every whole text; ``und`` and score 0 where it is null or has no letter."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = _Bundler()
        for b in _rows(batches):
            names, score = profiles.predict(*bundle(texts(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from all folds but one, predict all rows: ``(id, held_out, lang_pred, score)``.

    The fold of a row is crc32 of its id as text, modulo ``folds``; rows without an id
    are learnt from. Only text and non-null language are learnt from, only the text is
    predicted from. Nothing to learn from (or an empty table) makes all ``und``. Equal
    texts get equal predictions; extra columns are not read. A text with a letter but
    too short for an n-gram is like all languages, of which the first by name is given.
    A text is never cut, however long. The prototypes, one vector for each language,
    are broadcast: languages are taken to be thousands at most.
    """
    fold = crc_bucket(F.col(id_col), folds)
    profiles = fit(docs.filter(fold != held_out), text_col, lang_col)
    out = predict(docs, profiles, id_col, text_col)
    return out.select("id", (crc_bucket(F.col("id"), folds) == held_out).alias("held_out"), "lang_pred", "score")
