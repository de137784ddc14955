"""Removal of long repeated strings by hash-compared suffix sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier goes.
A suffix array over all bytes cannot be held, nor is it needed: only suffixes that
could share ``LENGTH`` bytes have to be sorted against each other.

1. Anchors. In every window of ``LENGTH`` bytes the ``GRAM``-byte string with the
   smallest hash is the window's anchor (the leftmost of equal ones). Equal windows
   have equal anchors at equal places, so only windows of one anchor value can be
   equal. Neighbouring windows share an anchor; about one byte in 37 is one. The
   bytes around an anchor that its windows cover are its context.
2. Contexts. Anchors meet by value, as packed columns. One whose whole context was
   seen earlier (by two independent 64-bit hashes, on top of the anchor's own) is
   repeated in all its windows. An anchor value with one context is settled; values with several differing
   contexts go on, with the first of each.
3. Suffixes. The contexts of one value are sorted as suffixes that start at the anchor,
   and once more as reversed prefixes that end there, each by a mergesort whose
   comparisons find the common extension of two strings by binary search over prefix
   polynomial hashes. Neighbours' common extensions are verified byte by byte, and a
   collision makes that sort fall back on bytes. From both orders the windows at any
   place that are equal fall out as runs: equal to the right for so many bytes, equal
   to the left for the rest.

A value with more than ``HOT`` differing contexts is no longer one piece of work: its
windows are dealt by their own bytes, and the first of each is an aggregate. Both ways
give the same windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, fresh, materialize, partitions, small_batches, trim
from .terms import U, mix

LENGTH, GRAM = 100, 32
#: Differing contexts of one anchor value that are still sorted in one task.
HOT = 50_000
#: Anchors a task gathers before it sends them.
FLUSH = 1 << 18
#: Contexts that are sorted at once.
SORTED = 1 << 14

_B = 0x9E3779B97F4A7C15 | 1
_B2 = 0xC2B2AE3D27D4EB4F | 1


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, b, U)])) for b in (self.base, self.inverse))
        return self.up, self.down


_POWERS = _Powers(_B)
_VALUE = mix(np.arange(256, dtype=U) + U(99))


#: A second hash, of other values of the bytes and another base, that no collision of the first is likely to share.
_CHECK_POWERS = _Powers(_B2)
_CHECK_VALUE = mix(np.arange(256, dtype=U) + U(0x5EED))


def _prefix(data: np.ndarray, powers: _Powers, value: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: entry i is that of the first i bytes."""
    up, _ = powers.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(value[data] * up[: len(data)], out=out[1:])
    return out


#: Bytes of a text whose anchors are found at once; a longer text is worked on in stretches that overlap by a window.
STRETCH = 1 << 20


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, stretch: int | None = None) -> tuple[np.ndarray, ...]:
    """``(value, two context hashes, place, first window, last window)`` of the anchors of a text of at least ``length`` bytes.

    Where a stretch of a long text ends, an anchor's windows are cut in two groups, each with a context of its own.
    """
    step = stretch or STRETCH
    parts = []
    for at in range(0, len(data) - length + 1, step):
        *hashes, place, first, last = _anchors(data[at : at + step + length - 1], length, gram)
        parts.append((*hashes, place + np.int32(at), first + at, last + at))
    return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))


def _anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    span = length - gram + 1
    pre, check = _prefix(data, _POWERS, _VALUE), _prefix(data, _CHECK_POWERS, _CHECK_VALUE)
    _, down = _POWERS.upto(len(data) + 1)
    _, check_down = _CHECK_POWERS.upto(len(data) + 1)
    value = mix((pre[gram:] - pre[:-gram]) * down[: len(data) - gram + 1])
    least, at, have = value, np.arange(len(value), dtype=np.int32), 1
    while have < span:
        step = min(have, span - have)
        left = least[:-step] <= least[step:]
        least, at = np.where(left, least[:-step], least[step:]), np.where(left, at[:-step], at[step:])
        have += step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    shape = (place - first).astype(U) * U(1_000_003) + (last - first).astype(U)
    context = mix((pre[last + length] - pre[first]) * down[first] ^ shape)
    second = mix((check[last + length] - check[first]) * check_down[first] ^ shape)
    return value[place], context, second, place, first, last


_COLUMNS = (("<u8", "h"), ("<u8", "c"), ("<u8", "k"), ("<i8", "doc"), ("<i4", "p"), ("<i4", "lo"), ("<i4", "hi"))


def _pack(columns: list[np.ndarray]) -> bytes:
    press = zstandard.ZstdCompressor(level=1)
    return press.compress(b"".join(np.ascontiguousarray(c, dtype=t).tobytes() for c, (t, _) in zip(columns, _COLUMNS, strict=True)))


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for t, _ in _COLUMNS:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _firsts(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns in order of value, context, document and place; and which rows are the first of their context.

    A context is told by both its hashes, so that a collision of one does not make two of them one.
    """
    h, c, k, doc, _, lo, _ = cols
    order = np.lexsort((lo, doc, k, c, h))
    cols = [x[order] for x in cols]
    h, c, k = cols[:3]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (k[1:] != k[:-1])
    return cols, first


def _runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows merged where they touch."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    if not len(doc):
        return doc, lo, hi
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.maximum.reduceat(hi, at)


#: Kind 0: windows lo to hi are repeated. Kind 1: a context to be sorted. Kind 2: one of a hot value.
FOUND = "kind int, h long, doc long, p int, lo int, hi int"


def _found(kind, h, doc, p, lo, hi) -> pa.Table:
    n = len(doc)
    cols = [np.full(n, kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32), np.asarray(h).astype(U).view(np.int64), doc.astype(np.int64), p.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32)]
    return pa.table([pa.array(c) for c in cols], names=["kind", "h", "doc", "p", "lo", "hi"])


def _settle_contexts(base: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """Steps 1 and 2: ``FOUND`` rows of all texts of ``base(doc, text)``."""
    spark = base.sparkSession
    buckets = 4 * partitions(spark)

    def send(held: list[list[np.ndarray]], task: int) -> Iterator[pa.RecordBatch]:
        cols, first = _firsts([np.concatenate([x[i] for x in held]) for i in range(len(_COLUMNS))])
        bucket = (cols[0] >> U(32)) % U(buckets)
        keep = [c[first] for c in cols]
        order = np.argsort(bucket[first], kind="stable")
        keep, b = [c[order] for c in keep], bucket[first][order]
        cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        ends = np.append(cuts[1:], len(b))
        rows = [(int(b[s]), 0, int(e - s), _pack([c[s:e] for c in keep])) for s, e in zip(cuts, ends, strict=True)]
        again = ~first
        doc, lo, hi = _runs(cols[3][again], cols[5][again], cols[6][again])
        if len(doc):  # repeated within this task already: only carried along
            none = np.zeros(len(doc), U)
            rows.append((task % buckets, 1, len(doc), _pack([none, none, none, doc, lo, lo, hi])))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[i : i + 256], strict=True), kinds, strict=True)], names=["bucket", "done", "n", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        task = TaskContext.get().partitionId()
        for b in cut(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                h, c, k, p, lo, hi = anchors(np.frombuffer(raw, np.uint8), length, gram)
                held.append([h, c, k, np.full(len(h), doc, np.int64), p, lo, hi])
                n += len(h)
                if n >= FLUSH:
                    yield from send(held, task)
                    held, n = [], 0
        if held:
            yield from send(held, task)
        del held
        trim()

    def settle(t: pa.Table) -> pa.Table:
        parts = [_unpack(r["blob"], r["n"]) for r in t.select(["n", "blob"]).filter(pa.compute.equal(t["done"], 0)).to_pylist()]
        done = [_unpack(r["blob"], r["n"]) for r in t.select(["n", "blob"]).filter(pa.compute.equal(t["done"], 1)).to_pylist()]
        out = [_found(0, x[0], *x[3:]) for x in done]
        if parts:
            cols, first = _firsts([np.concatenate([x[i] for x in parts]) for i in range(len(_COLUMNS))])
            h = cols[0]
            value = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
            contexts = np.bincount(value, weights=first).astype(np.int64)[value]
            kind = np.where(~first, 0, np.where(contexts > hot, 2, 1))
            say = ~first | (contexts > 1)
            out.append(_found(kind[say], *[cols[i][say] for i in (0, 3, 4, 5, 6)]))
        return pa.concat_tables(out) if out else _found(0, *[np.zeros(0)] * 5)

    blobs = base.mapInArrow(gather, "bucket int, done int, n int, blob binary")
    return materialize(blobs.groupBy("bucket").applyInArrow(settle, FOUND), "found")


def _hash_rows(x: np.ndarray) -> np.ndarray:
    """(n, width + 1) prefix polynomial hashes of the rows of a byte matrix."""
    up = _POWERS.upto(x.shape[1] + 1)[0]
    out = np.zeros((len(x), x.shape[1] + 1), U)
    np.cumsum(_VALUE[x] * up[: x.shape[1]], axis=1, out=out[:, 1:])
    return out


class SuffixSort:
    """Order of the byte strings of each group: rows of ``text`` (zero-padded), ``size`` bytes each, ``group`` in order.

    ``order`` sorts within groups; ``common[i]`` is the verified common extension of
    rows ``order[i - 1]`` and ``order[i]`` (-1 where a group starts).
    """

    def __init__(self, text: np.ndarray, size: np.ndarray, group: np.ndarray):
        self.text, self.size = text, size
        self.hashes = _hash_rows(text)
        n = len(group)
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        self.order = self._mergesort(np.flatnonzero(new), n)
        del self.hashes
        common = self._verified(self.order, new)
        if common is None:  # two different strings with one hash: sort by the bytes themselves
            keys = [size] + [text[:, i] for i in range(text.shape[1] - 1, -1, -1)] + [group]
            self.order = np.lexsort(keys)
            common = self._verified(self.order, new, check=False)
        self.common = common

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many leading bytes rows a[i] and b[i] share, by binary search over their prefix hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b]).astype(np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = self.hashes[a, mid] == self.hashes[b, mid]
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)

    def _less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row a[i] comes before row b[i]; a string comes before those it begins; rows in order break ties."""
        n = self.extension(a, b)
        last = self.text.shape[1] - 1
        x, y = self.text[a, np.minimum(n, last)], self.text[b, np.minimum(n, last)]
        end_a, end_b = n == self.size[a], n == self.size[b]
        return np.where(end_a & end_b, a < b, np.where(end_a, True, np.where(end_b, False, x < y)))

    def _mergesort(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Bottom-up merges of neighbouring runs, in all groups at once."""
        sizes = np.diff(np.append(starts, n))
        order = np.arange(n)
        run = 1
        while True:
            big = sizes > run
            if not big.any():
                return order
            s, g = starts[big], sizes[big]
            at = np.repeat(s, g) + _ramp(g)
            q = at - np.repeat(s, g)
            left_start = np.repeat(s, g) + (q // (2 * run)) * (2 * run)
            group_end = np.repeat(s + g, g)
            middle = np.minimum(left_start + run, group_end)
            end = np.minimum(left_start + 2 * run, group_end)
            is_left = at < middle
            # rank of each row in the sibling run
            lo, hi = np.where(is_left, middle, left_start), np.where(is_left, end, middle)
            base = lo.copy()
            mine = order[at]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                other_first = self._less(order[mid], mine[open_])
                lo[open_] = np.where(other_first, mid + 1, lo[open_])
                hi[open_] = np.where(other_first, hi[open_], mid)
            target = left_start + (at - np.where(is_left, left_start, middle)) + (lo - base)
            merged = order.copy()
            merged[target] = mine
            order = merged
            run *= 2

    def _verified(self, order: np.ndarray, new: np.ndarray, check: bool = True) -> np.ndarray | None:
        """Neighbours' common extensions by the bytes; None if the order is not that of the bytes."""
        common = np.full(len(order), -1, np.int64)
        inside = np.flatnonzero(~new)
        if len(inside):
            a, b = order[inside - 1], order[inside]
            least = np.minimum(self.size[a], self.size[b])
            differ = self.text[a] != self.text[b]
            n = np.where(differ.any(axis=1), differ.argmax(axis=1), self.text.shape[1])
            n = np.minimum(n, least)
            common[inside] = n
            if check:
                last = self.text.shape[1] - 1
                x, y = self.text[a, np.minimum(n, last)], self.text[b, np.minimum(n, last)]
                good = np.where(n == least, self.size[a] <= self.size[b], x < y)
                if not good.all():
                    return None
        return common


def _ramp(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _rows_of(raw: list[bytes], width: int, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as a zero-padded matrix, and their sizes."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8)
    out = np.zeros((len(raw), max(1, width)), np.uint8)
    row, at = np.repeat(np.arange(len(raw)), size), _ramp(size)
    if reverse:
        at = np.repeat(size, size) - 1 - at
    out[row, at] = flat
    return out, size


def repeated_windows(h: np.ndarray, doc: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, raw: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Step 3 for contexts in order of value, document and place: ``(row, window)`` of all windows seen earlier."""
    before = (p - lo).astype(np.int64)
    after = (p - hi).astype(np.int64)
    right = SuffixSort(*_rows_of([r[b:] for r, b in zip(raw, before, strict=True)], length), h)
    left = SuffixSort(*_rows_of([r[:b] for r, b in zip(raw, before, strict=True)], length - gram, reverse=True), h)
    rows, windows = [], []
    right_class, left_class = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    for back in range(int(after.min()), int(before.max()) + 1):
        own = np.flatnonzero((after <= back) & (back <= before))
        if len(own) < 2:
            continue
        right_class[right.order] = np.cumsum(right.common < length - back)
        left_class[left.order] = np.cumsum(left.common < back)
        key = right_class[own] * (len(h) + 1) + left_class[own]
        _, first, at = np.unique(key, return_index=True, return_inverse=True)
        again = own[first[at] != np.arange(len(own))]
        rows.append(again)
        windows.append(p[again].astype(np.int64) - back)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(windows)


def _sort_contexts(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Step 3: ``(doc, lo, hi)`` of repeated windows, from ``contexts(h, doc, p, lo, hi, raw)``."""
    buckets = 4 * partitions(contexts.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        h = t["h"].to_numpy()
        doc, p = t["doc"].to_numpy(), t["p"].to_numpy()
        order = np.lexsort((p, doc, h))
        t = t.take(pa.array(order))
        h, doc, p, lo, hi = (t[c].to_numpy() for c in ("h", "doc", "p", "lo", "hi"))
        raw = t["raw"].to_pylist()
        out = []
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        ends = np.append(starts[1:], len(h))
        i = 0
        while i < len(starts):  # as many whole values as may be sorted at once
            j = max(i, int(np.searchsorted(ends, starts[i] + SORTED, side="right")) - 1)
            s = slice(int(starts[i]), int(ends[j]))
            row, window = repeated_windows(h[s], doc[s], p[s], lo[s], hi[s], raw[s], length, gram)
            out.append((doc[s][row], window))
            i = j + 1
        d, w = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
        d, a, e = _runs(d, w, w)
        return pa.table([pa.array(d.astype(np.int64)), pa.array(a.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc", "lo", "hi"])

    dealt = contexts.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(run, "doc long, lo int, hi int")


def _hot_windows(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of hot values, each window dealt by its own bytes, of which the first is an aggregate."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            for doc, lo, hi, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                at = np.arange(lo, hi + 1, dtype=np.int32)
                rows = [raw[i : i + length] for i in range(len(at))]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(np.full(len(at), doc, np.int64)), pa.array(at)], names=["bytes", "doc", "at"])

    windows = materialize(contexts.select("doc", "lo", "hi", "raw").mapInArrow(explode, "bytes binary, doc long, at int"), "windows")
    key = ["bytes"]
    first = materialize(windows.groupBy(*key).agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    again = windows.join(first, key).filter((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    return again.select("doc", F.col("at").alias("lo"), F.col("at").alias("hi"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, rid: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a unique long ``rid`` in order of id, and its ``(doc, text)``.

    The id itself, unless rows repeat or lack it; then rows are numbered in order of
    id (null last) and a hash of the text.
    """
    counted = docs.agg(F.count("*").alias("n"), F.count_distinct(F.col(id_col)).alias("d")).head()
    if counted.n == counted.d:
        keyed = docs.withColumn(rid, F.col(id_col).cast("long"))
    else:
        keyed = materialize(docs.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(text_col)).withColumn(rid, F.monotonically_increasing_id()), "keyed")
    return keyed, keyed.select(F.col(rid).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _repeated(base: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """``(doc, spans array<struct<lo, hi>>)``: ranges of windows that start earlier elsewhere, one row per document."""
    found = _settle_contexts(base, length, gram, hot)
    wanted = found.filter("kind > 0").groupBy("doc").agg(F.collect_list(F.struct("kind", "h", "p", "lo", "hi")).alias("wanted"))

    def excerpt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            rows = []
            for doc, text, wanted in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(w["kind"], w["h"], doc, w["p"], w["lo"], w["hi"], raw[w["lo"] : w["hi"] + length]) for w in wanted]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "h", "doc", "p", "lo", "hi", "raw"])

    contexts = base.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(excerpt, FOUND + ", raw binary")
    contexts = materialize(contexts, "contexts")
    spans = found.filter("kind = 0").select("doc", "lo", "hi").unionByName(_sort_contexts(contexts.filter("kind = 1"), length, gram))
    if found.filter("kind = 2").limit(1).count():
        spans = spans.unionByName(_hot_windows(contexts.filter("kind = 2"), length))
    spans = materialize(spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    discard(contexts)
    discard(found)
    return spans


def _removed(size: int, spans: list[dict] | None, length: int) -> np.ndarray:
    """Whether each byte of a text is covered by a repeated window."""
    step = np.zeros(size + 1, np.int64)
    if spans:
        np.add.at(step, [s["lo"] for s in spans], 1)
        np.add.at(step, [s["hi"] + length for s in spans], -1)
    return np.cumsum(step)[:size] > 0


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per row ``(id, n_bytes, n_removed, n_spans, kept_sha256)``.

    Every byte covered by a ``length``-byte string that also starts earlier (at a
    smaller id, or earlier in the same text) counts as removed, judged on the input;
    ``n_spans`` are the maximal removed runs and the digest is that of what stays.
    Matches never cross texts. Null texts count as empty. Rows that repeat an id, and
    after all others rows without one, are ordered by a hash of their text, so of equal
    rows all but one are removed. An empty table gives no rows; extra columns are not read.
    A text is never cut for good: anchors of one longer than ``STRETCH`` bytes are found
    a stretch at a time, and its windows are those of the whole.
    """
    small_batches(docs.sparkSession)
    keyed, base = _keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", "_rid")
    spans = _repeated(base, length, gram, hot)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            rows = []
            for id_, text, marks in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                gone = _removed(len(raw), marks, length)
                n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(len(gone) and gone[0]))
                rows.append((id_, len(raw), int(gone.sum()), n_spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = keyed.join(spans, F.col("_rid") == F.col("doc"), "left").select("id", "text", "spans")
    return joined.mapInArrow(measure, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings taken out of the text; same columns and rows, clashing names included.

    A character of which only some bytes go is dropped whole. ``chars_col``, where it
    exists, is set to the new number of characters of changed texts. Null texts stay
    null; rows that repeat or lack an id are ordered as in ``repeats``; an empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    rid, key, marks_col = fresh(docs, "_rid", "_doc", "_spans")
    keyed, base = _keyed(docs, id_col, text_col, rid)
    spans = _repeated(base, length, GRAM, HOT).select(F.col("doc").alias(key), F.col("spans").alias(marks_col))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            out = []
            for text, marks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if marks:
                    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    text = raw[~_removed(len(raw), marks, length)].tobytes().decode("utf-8", "ignore")
                out.append(text)
            new = pa.array(out, pa.string())
            cols = [new if n == "_text" else b.column(i) for i, n in enumerate(b.schema.names) if n != "_spans"]
            yield pa.RecordBatch.from_arrays(cols, names=[n for n in b.schema.names if n != "_spans"])

    rest = [F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns) if c != text_col]
    joined = keyed.join(spans, F.col(rid) == F.col(key), "left").select(F.col(text_col).alias("_text"), F.col(marks_col).alias("_spans"), *rest)
    kinds = ", ".join(f"`_{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(docs.columns) if c != text_col)
    done = joined.mapInArrow(strip, "`_text` string" + (", " + kinds if kinds else ""))
    out = []
    for i, c in enumerate(docs.columns):
        if c == text_col:
            out.append(F.col("_text").alias(c))
        elif c == chars_col:
            out.append(F.coalesce(F.length("_text"), F.col(f"_{i}")).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"_{i}").alias(c))
    return done.select(*out)


ORACLE_SQL = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), w as (
  select doc_id, i, substr(h, 2 * i + 1, 200) as s from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as i from d)
), f as (
  select s, min(doc_id * 4294967296 + i) as first from w group by s having count(*) > 1
), dup as (
  select w.doc_id, w.i from w join f on w.s = f.s where w.doc_id * 4294967296 + w.i <> f.first
), g as (
  select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as fresh from dup
), runs as (
  select doc_id, min(i) as a, max(i) + 100 as e from (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as k from g) group by doc_id, k
), gaps as (
  select doc_id, coalesce(lag(e) over (partition by doc_id order by a), 0) as a, a as e from runs
  union all select doc_id, max(e), null from runs group by doc_id
  union all select doc_id, 0, null from d where doc_id not in (select doc_id from runs)
), kept as (
  select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(e, length(h) // 2) - a)), '' order by a) as h from gaps join d using (doc_id) group by doc_id
)
select d.doc_id, cast(length(d.h) // 2 as bigint) as n_bytes, cast((length(d.h) - length(kept.h)) // 2 as bigint) as n_removed,
  (select count(*) from runs where runs.doc_id = d.doc_id) as n_spans, sha256(unhex(kept.h)) as kept_sha256
from d join kept using (doc_id)
"""
