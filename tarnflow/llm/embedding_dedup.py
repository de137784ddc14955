"""Near-duplicate vectors by product quantisation.

Fit (on a bounded sample): k-means centroids of the unit vectors cut the space
into inverted lists; the residuals to them are cut into subspaces, each with a
codebook of its own. Index (every vector): its list, the codes of its residual,
and how far the codes are off.

Search (every vector): the lists of the nearest centroids are probed. A query's
distances to all codes of a subspace make a table, so that a member's approximate
distance is a sum of looked-up entries. By the triangle inequality a member is
ruled out only if the approximate distance less the member's own error is beyond
the limit, so the codes lose nothing; what remains is compared by exact cosine.

A list is searched in blocks of members and queries, so a list that holds a third
of all vectors is many pieces of work. A block returns how many links each vector
has in it and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, materialize
from .components import components
from .forest import merge, settle

#: Vectors per list aimed at, lists for each root of the number of vectors, lists probed, vectors per list in the
#: sample and in all of it.
LIST, ROOTS, PROBES, PER_LIST, SAMPLE = 128, 4, 16, 64, 1 << 18
#: Subspaces and codes in each.
PARTS, CODES = 8, 256
#: Members and queries of a block.
BLOCK = 512


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids (at most k) by Lloyd's rounds from a seeded draw; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the ``n`` nearest rows of ``c`` for each row of ``x``, nearest first; ties by number."""
    out = np.empty((len(x), min(n, len(c))), np.int32)
    half = (c * c).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        d = half - x[i : i + 4096] @ c.T
        if out.shape[1] == 1:
            out[i : i + 4096, 0] = d.argmin(axis=1)
        else:
            top = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
            top = np.sort(top, axis=1)
            order = np.argsort(np.take_along_axis(d, top, axis=1), axis=1, kind="stable")
            out[i : i + 4096] = np.take_along_axis(top, order, axis=1)
    return out


@dataclass
class Quantizer:
    """Centroids (lists, dim) and codebooks (parts, codes, width), with the columns of each part."""

    centroids: np.ndarray
    books: list[np.ndarray]
    columns: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray, lists: int) -> Quantizer:
        centroids = _kmeans(sample, lists)
        rest = sample - centroids[_nearest(sample, centroids, 1)[:, 0]]
        columns = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        return Quantizer(centroids, [_kmeans(rest[:, c], CODES) for c in columns], columns)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probed lists (the first is the vector's own), codes and the distance that the codes are off."""
        probes = _nearest(x, self.centroids, PROBES)
        rest = x - self.centroids[probes[:, 0]]
        codes = np.empty((len(x), len(self.columns)), np.uint8)
        off = np.zeros(len(x))
        for i, (c, book) in enumerate(zip(self.columns, self.books, strict=True)):
            codes[:, i] = _nearest(rest[:, c], book, 1)[:, 0]
            off += ((rest[:, c] - book[codes[:, i]]) ** 2).sum(axis=1)
        return probes, codes, np.sqrt(off)

    def approximate(self, queries: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances (queries, members) of queries to coded members of a list, by table look-up."""
        rest = queries - self.centroids[list_]
        out = np.zeros((len(queries), len(codes)))
        for i, (c, book) in enumerate(zip(self.columns, self.books, strict=True)):
            r = rest[:, c]
            entries = (r * r).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None, :] - 2 * r @ book.T
            out += entries[:, codes[:, i]]
        return np.maximum(out, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square of a component is too large or too small
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v array<double>)`` of the rows that can link: with an id and a finite, non-zero vector without nulls."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))


def lists_for(n: int) -> int:
    """Inverted lists for ``n`` vectors: of about ``LIST`` vectors, but no more than ``ROOTS`` times the root of ``n``.

    So lists and their length both grow, and a vector meets about ``PROBES / ROOTS``
    times the root of ``n`` others.
    """
    return max(1, min(n // LIST, int(ROOTS * n**0.5)))


def _links(points: DataFrame, n: int, dim: int, threshold: float, kind: str) -> DataFrame:
    """Distinct ``points(rep, mult, v)`` of one dimension to ``(kind, a, b)``; vectors travel as numbers of ``kind``, which holds them exactly.

    Kind 0: vector ``a`` has ``b`` more linked vectors (copies counted); kind 1: ``a``
    and ``b`` are connected.
    """
    lists = lists_for(n)
    bound = min(SAMPLE, lists * PER_LIST) if lists > 1 else 4 * LIST
    share = min(1.0, 1.2 * bound / n)
    drawn = points if share >= 1 else points.filter(F.xxhash64(F.lit(11), "rep") < F.lit(int(-(1 << 63) + share * ((1 << 64) - 1024))))
    sample = drawn.select("rep", "v").orderBy(F.xxhash64(F.lit(11), "rep")).limit(bound).toArrow()
    q = Quantizer.fit(_unit(_matrix(sample.column("v").combine_chunks())), lists)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 4096):
            v = _matrix(b.column(2))
            probes, codes, off = q.encode(_unit(v))
            cols = [b.column(0), b.column(1), pa.array([r.tobytes() for r in v.astype(kind)], pa.binary()), pa.array(list(probes), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off)]
            yield pa.RecordBatch.from_arrays(cols, names=["rep", "mult", "x", "probes", "codes", "off"])

    indexed = materialize(points.select("rep", "mult", "v").mapInArrow(index, "rep long, mult long, x binary, probes array<int>, codes binary, off double"), "index")
    # one row per list: how many blocks of members and queries it has
    members = {r.l: r.n for r in indexed.groupBy(F.col("probes")[0].alias("l")).agg(F.count("*").alias("n")).collect()}
    queries = {r.l: r.n for r in indexed.select(F.explode("probes").alias("l")).groupBy("l").agg(F.count("*").alias("n")).collect()}
    cells = {i: (-(-members.get(i, 0) // BLOCK), -(-queries.get(i, 0) // BLOCK)) for i in queries}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 2048):
            rep = b.column(0).to_numpy()
            at, key, role = [], [], []
            for i, p in enumerate(b.column(3).to_pylist()):
                h = int(rep[i]) * 0x9E3779B97F4A7C15 % (1 << 64) >> 20
                m, k = cells[p[0]]
                for j in range(k):
                    at.append(i)
                    key.append((p[0], h % m, j))
                    role.append(0)
                for l in p:
                    m, k = cells[l]
                    for j in range(m):
                        at.append(i)
                        key.append((l, j, h % k))
                        role.append(1)
            t = b.take(pa.array(at, pa.int64()))
            l, m, k = (pa.array(list(c), pa.int32()) for c in zip(*key, strict=True))
            own = pa.array([r == 0 for r in role])
            none = pa.nulls(len(at), pa.binary())
            codes = pa.compute.if_else(own, t.column(4), none)
            yield pa.RecordBatch.from_arrays([l, m, k, pa.array(role, pa.int32()), t.column(0), t.column(1), t.column(2), t.column(3), codes, t.column(5)], names=["l", "m", "k", "role", "rep", "mult", "x", "probes", "codes", "off"])

    far = np.sqrt(2 - 2 * threshold) + 1e-9

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        list_ = int(pdf.l.iloc[0])
        pdf = pdf.sort_values(["role", "rep"])
        y, x = pdf[pdf.role == 0], pdf[pdf.role == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"kind": [], "a": [], "b": []}).astype("int64")
        yv, xv = (_unit(np.frombuffer(b"".join(s.x), kind).astype(np.float64).reshape(len(s), dim)) for s in (y, x))
        yc = np.frombuffer(b"".join(y.codes), np.uint8).reshape(len(y), -1)
        near = np.sqrt(q.approximate(xv, list_, yc)) - y.off.to_numpy()[None, :] <= far
        i, j = np.nonzero(near)
        xr, yr = x.rep.to_numpy(), y.rep.to_numpy()
        other = xr[i] != yr[j]
        i, j = i[other], j[other]
        hit = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 15):
            c = slice(s, s + (1 << 15))
            hit[c] = (xv[i[c]] * yv[j[c]]).sum(axis=1) >= threshold
        i, j = i[hit], j[hit]
        # a pair is counted for the query; and for the member, if its own search does not come to the query's list
        asked = np.zeros((len(y), len(q.centroids)), bool)
        for n_, p in enumerate(y.probes):
            asked[n_, p] = True
        home = np.array([p[0] for p in x.probes], np.int64)
        xm, ym = x.mult.to_numpy(), y.mult.to_numpy()
        for_x = np.bincount(i, weights=ym[j], minlength=len(x)).astype(np.int64)
        alone = ~asked[j, home[i]]
        for_y = np.bincount(j[alone], weights=xm[i[alone]], minlength=len(y)).astype(np.int64)
        ids, place = np.unique(np.concatenate([xr, yr]), return_inverse=True)
        heads = np.arange(len(ids))
        merge(heads, place[i], place[len(x) + j])
        heads = settle(heads)
        tied = np.flatnonzero(heads != np.arange(len(ids)))
        fx, fy = for_x > 0, for_y > 0
        return pd.DataFrame(
            {
                "kind": np.concatenate([np.zeros(fx.sum() + fy.sum(), np.int64), np.ones(len(tied), np.int64)]),
                "a": np.concatenate([xr[fx], yr[fy], ids[tied]]),
                "b": np.concatenate([for_x[fx], for_y[fy], ids[heads[tied]]]),
            }
        )

    schema = "l int, m int, k int, role int, rep long, mult long, x binary, probes array<int>, codes binary, off double"
    return indexed.mapInArrow(deal, schema).groupBy("l", "m", "k").applyInPandas(search, "kind long, a long, b long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per input row: ``(id, n_links, component)``.

    ``n_links``: other rows whose vectors have a cosine of at least ``threshold`` (in
    double precision); ``component``: the smallest id reachable by links. Vectors
    that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do rows without an id (component null) or vectors of different
    length. Equal vectors are searched once and counted as often as they occur. An
    empty table gives no rows; extra columns are not read.

    The search is exact but for links whose vectors are not in each other's probed lists.
    """
    points = usable(vectors, id_col, vec_col).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    points = materialize(points, "points")
    sizes = points.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()
    kind = "<f4" if vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType()) or vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType(), False) else "<f8"
    found = None
    for r in sorted(sizes):
        part = _links(points.filter(F.size("v") == r.dim), r.n, r.dim, threshold, kind)
        found = part if found is None else found.unionByName(part)
    spark = vectors.sparkSession
    if found is None:
        found = spark.createDataFrame([], "kind long, a long, b long")
    found = materialize(found, "links")
    labels = components(found.filter("kind = 1").select("a", "b"))
    counts = materialize(found.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("more")), "counts")
    classes = points.select("v", F.col("rep").alias("r"), "mult").join(counts, F.col("r") == F.col("a"), "left").drop("a")
    classes = classes.join(labels, F.col("r") == F.col("node"), "left")
    classes = materialize(classes.select("v", (F.coalesce("more", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("label", "r").alias("c")), "classes")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("u"))
    out = base.join(classes, (F.col("u") == F.col("v")) & F.col("id").isNotNull(), "left")
    return out.select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("c", "id").alias("component"))


ORACLE_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as x from embeddings
  where len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(embedding, lambda e: e <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.9
), reach as (
  select vec_id as a, vec_id as b from embeddings union select reach.a, links.b from reach join links on links.a = reach.b
)
select vec_id, (select count(*) from links where links.a = vec_id) as n_links, r.c as component_id, vec_id = r.c as kept
from embeddings join (select a, min(b) as c from reach group by a) r on r.a = vec_id
"""
