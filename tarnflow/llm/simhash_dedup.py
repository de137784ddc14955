"""SimHash near-duplicates by a binary-trie self-join.

A fingerprint is a path of 64 bits in a binary trie. Two sub-tries are walked
together: a pair of nodes carries the number of bits in which its paths differ
so far and is dropped once that exceeds the budget.

The walk is dealt out over the cluster. With a budget of k errors, cut the path
into k+1 blocks: two fingerprints within k bits agree in at least one block. So
the trie is built k+1 times, each time with another block on top, and only node
pairs that agree on that block are walked; each such node is a piece of work.
A node with more fingerprints than one task should hold is not walked there: its
pairs of children eight levels further down become pieces of work of their own,
again and again until all are small (``_split``). Nothing is capped.

Within a task every link found is merged at once, so that a task returns for
each fingerprint at most one link (to the head of its local group) and no group
of copies ever becomes a list of all its pairs. Node pairs all of whose
fingerprints are in one group already are not walked any further.

``simhash_groups`` links 64-bit fingerprints within a few bits. Texts of a set
similarity of 0.8 differ in about 15 of 100 bits, too many for that, so the near
copies of texts (``similar_groups``) are sought by fingerprints of 192 bits, cut into
segments of 32 that are joined by the same walk, each with a budget of 2. What the
walk finds are candidates; the sets of shingles decide every link. Links that
fingerprints miss are found by prefixes: of two sets of n and m shingles with a
Jaccard of t or more, put in one order, the first n - ceil(tn) + 1 and
m - ceil(tm) + 1 share a shingle (``_completed``). So links are exact and complete,
and a walk of candidates need not compare all there is in a crowded node.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SKETCH, WORD, cut, discard, fresh, materialize, partitions, sketch, sketched, small_batches, texts, trim
from .components import components
from .forest import merge, root, settle
from .suffix_dedup import _keyed
from .terms import U, Words, code_points, is_space, mix

BITS = 64
#: A piece of work (pair of trie nodes) with more fingerprints than this is split.
NODE_LIMIT = 8192
#: Levels that one split goes down.
STEP = 8
#: Node pairs that are walked at once, and rows that a task of the walk gets.
FRONTIER, TASK_ROWS = 1 << 17, 1 << 19


def simhash_text(text: str, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over the ``width``-word shingles of ``text``.

    Words are runs of non-space bytes after A-Z are lower-cased; fewer words than
    ``width`` make one shingle, no words give 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(b" ".join(words), seed)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens).tolist()
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)], dtype="<u8")
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp long)`` of every row; null text counts as empty, so its ``fp`` is 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            fps = np.array([simhash_text(t, width) for t in texts(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, fp long")


def _masks(budget: int) -> list[int]:
    return [m for m in range(1 << STEP) if m.bit_count() <= budget]


def _rotations(fps: DataFrame, budget: int) -> DataFrame:
    """One row per fingerprint and block: ``(tab, depth, a, b, side, path, id, full)``, path = bits with that block on top."""
    parts = budget + 1
    rows = []
    for t in range(parts):
        by = BITS * t // parts
        top = BITS * (t + 1) // parts - by
        path = F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", BITS - by)) if by else F.col("fp")
        node = F.shiftrightunsigned(path, BITS - top)
        rows.append(F.struct(F.lit(t).alias("tab"), F.lit(top).alias("depth"), node.alias("a"), node.alias("b"), F.lit(0).alias("side"), path.alias("path")))
    return fps.select("fp", F.explode(F.array(*rows)).alias("r")).select("r.*", F.col("fp").alias("id"), F.lit(0).cast("long").alias("more"))


KEY = ["tab", "depth", "a", "b"]


def _split(work: DataFrame, budget: int, limit: int) -> DataFrame:
    """Deal pieces of work with more than ``limit`` fingerprints to pairs of child nodes, until none is left that has children.

    Pairs of children more than ``budget`` bits apart are none.
    """
    while True:
        large = materialize(work.groupBy(*KEY).count().filter((F.col("count") > limit) & (F.col("depth") < BITS)).drop("count"), "large")
        if large.limit(1).count() == 0:
            discard(large)
            return work
        marked = work.join(large.withColumn("large", F.lit(True)), KEY, "left")
        calm = marked.filter("large is null").drop("large")
        step = F.least(F.lit(STEP), F.lit(BITS) - F.col("depth"))
        err = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        hot = marked.filter("large").withColumn("step", step).withColumn("own", _low_bits(F.expr(f"shiftrightunsigned(path, {BITS} - depth - step)"), "step"))
        hot = hot.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in _masks(budget)])))
        hot = hot.filter((err + F.bit_count("mask") <= budget) & (F.col("mask") < F.expr("shiftleft(1, step)")))
        other = F.col("own").bitwiseXOR(F.col("mask").cast("long"))
        twin = F.col("a") == F.col("b")
        mine = F.expr("shiftleft(case when side = 0 then a else b end, step)").bitwiseOR(F.col("own"))
        theirs = F.expr("shiftleft(case when side = 0 then b else a end, step)").bitwiseOR(other)
        first = F.when(twin, mine <= theirs).otherwise(F.col("side") == 0)
        hot = hot.select(
            "tab",
            (F.col("depth") + F.col("step")).cast("int").alias("depth"),
            F.when(first, mine).otherwise(theirs).alias("a"),
            F.when(first, theirs).otherwise(mine).alias("b"),
            F.when(first, 0).otherwise(1).alias("side"),
            "path",
            "id",
            "more",
        )
        work = materialize(calm.select(*KEY, "side", "path", "id", "more").unionByName(hot), "work")


def _low_bits(value, width: str):
    return value.bitwiseAND(F.expr(f"shiftleft(1L, {width}) - 1"))


def trie_links(fps: DataFrame, budget: int = 3, limit: int = NODE_LIMIT) -> DataFrame:
    """Distinct ``fps(fp long)`` to links ``(a long, b long)`` that join all within ``budget`` bits.

    The links connect what is linked: each piece of work returns a spanning
    forest of its pairs, not the pairs.
    """
    work = _split(materialize(_rotations(fps, budget), "work"), budget, limit)
    return _walked(work, budget)


def _walked(work: DataFrame, budget: int, bits: int = BITS, whole: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between the ids of ``work`` rows whose paths differ in at most ``budget`` of their first ``bits`` bits.

    With ``whole`` links are candidates: of ``path`` and ``more`` together at most so
    many bits may differ, and rows that agree in all bits of the walk are compared
    with few others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        tab, depth, a, b, side, path, ids, more = (t.column(c).to_numpy() for c in (*KEY, "side", "path", "id", "more"))
        path, more = path.view(np.uint64), more.view(np.uint64)
        order = np.lexsort((path, side, b, a, depth, tab))
        tab, depth, a, b, side, path, ids, more = (c[order] for c in (tab, depth, a, b, side, path, ids, more))
        near = None
        if whole is not None:
            near = lambda x, y: _bits(path[x] ^ path[y]) + _bits(more[x] ^ more[y]) <= whole
        new = np.ones(len(tab), bool)
        new[1:] = (tab[1:] != tab[:-1]) | (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(tab))
        zeros = np.concatenate([[0], np.cumsum(side == 0)])
        mid = lo + (zeros[hi] - zeros[lo])
        heads = _walk(path, lo, mid, hi, depth[lo].astype(np.int64), a[lo], b[lo], budget, bits, near)
        link = np.flatnonzero(heads != np.arange(len(heads)))
        if len(link):
            yield pa.RecordBatch.from_arrays([pa.array(ids[link]), pa.array(ids[heads[link]])], names=["a", "b"])
        rows = t = near = path = more = ids = heads = None
        trim()

    tasks = max(partitions(work.sparkSession), work.count() // TASK_ROWS + 1)
    return work.repartition(tasks, *KEY).mapInArrow(run, "a long, b long")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _walk(path, lo, mid, hi, depth, a, b, budget: int, bits: int = BITS, near: Callable | None = None) -> np.ndarray:
    """Walk the trie pairs given by row ranges [lo, mid) x [mid, hi) (or [lo, hi) with itself where a == b).

    ``path`` is sorted within each range and has ``bits`` bits, the first on top.
    ``near`` decides on rows whose paths are within the budget. Returns for each row
    the row that heads its local group.
    """
    heads = np.arange(len(path))
    twin = a == b
    al, ah = lo, np.where(twin, hi, mid)
    bl, bh = np.where(twin, lo, mid), hi
    todo = [(al, ah, bl, bh, _bits((a ^ b).view(np.uint64)), depth)]
    while todo:
        part = todo.pop()
        if len(part[0]) > FRONTIER:
            half = len(part[0]) // 2
            todo.append(tuple(x[half:] for x in part))
            todo.append(tuple(x[:half] for x in part))
            continue
        al, ah, bl, bh, err, depth = part
        live = (ah > al) & (bh > bl) & (err <= budget)
        live &= ~((al == bl) & (ah == bh) & (ah - al == 1))
        if near is not None:
            at = np.flatnonzero(live)
            live[at] = ~_one_group(heads, al[at], ah[at], bl[at], bh[at])
        al, ah, bl, bh, err, depth = (x[live] for x in part)
        if not len(al):
            continue
        # pairs of single leaves: the rest of the path is compared at once
        leaf = (ah - al == 1) & (bh - bl == 1)
        end = ~leaf & (depth >= bits)
        if leaf.any():
            _link(heads, path, al[leaf], bl[leaf], budget, bits, near)
        if end.any():
            _link_ranges(heads, path, al[end], ah[end], bl[end], bh[end], budget, bits, near)
        on = ~leaf & ~end
        al, ah, bl, bh, err, depth = (v[on] for v in (al, ah, bl, bh, err, depth))
        if not len(al):
            continue
        am, bm = _child(path, al, ah, depth), _child(path, bl, bh, depth)
        same = (al == bl) & (ah == bh)
        nxt = depth + 1
        todo.append(
            (
                np.concatenate([al, am, al, am[~same]]),
                np.concatenate([am, ah, am, ah[~same]]),
                np.concatenate([bl, bm, bm, bl[~same]]),
                np.concatenate([bm, bh, bh, bm[~same]]),
                np.concatenate([err, err, err + 1, err[~same] + 1]),
                np.concatenate([nxt, nxt, nxt, nxt[~same]]),
            )
        )
    return settle(heads)


def _one_group(heads, al, ah, bl, bh) -> np.ndarray:
    """Whether all rows of both ranges have one head."""
    heads[:] = settle(heads)
    turns = np.concatenate([[0], np.cumsum(heads[1:] != heads[:-1])])
    return (heads[al] == heads[bl]) & (turns[ah - 1] == turns[al]) & (turns[bh - 1] == turns[bl])


def _link(heads, path, x, y, budget: int, bits: int, near: Callable | None) -> None:
    good = (_bits((path[x] ^ path[y]) >> U(BITS - bits)) <= budget) & (x != y)
    x, y = x[good], y[good]
    if near is not None and len(x):
        apart = root(heads, x) != root(heads, y)
        x, y = x[apart], y[apart]
        good = near(x, y)
        x, y = x[good], y[good]
    merge(heads, x, y)


def _link_ranges(heads, path, al, ah, bl, bh, budget: int, bits: int, near: Callable | None) -> None:
    """Rows of range pairs that have no more bits to part them: each with the head of the other side, and with its neighbour.

    Candidates only: without ``near`` such ranges have one row a side.
    """
    for lo, hi, other in ((al, ah, bl), (bl, bh, al)):
        n = hi - lo
        x = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        _link(heads, path, x, np.repeat(other, n), budget, bits, near)
        _link(heads, path, x, np.minimum(x + 1, np.repeat(hi, n) - 1), budget, bits, near)


def _child(path: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First row in each [lo, hi) whose bit at ``depth`` is 1 (rows are sorted, so zeros come first)."""
    lo, hi = lo.copy(), hi.copy()
    shift = (63 - depth).astype(np.uint64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = ((path[np.minimum(mid, len(path) - 1)] >> shift) & np.uint64(1)) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, width: int = 3, limit: int = NODE_LIMIT) -> DataFrame:
    """One row per input row: ``(id, fp long, component long)``.

    ``component`` is the smallest id that links of at most ``budget`` differing
    bits reach. Null and empty texts have fingerprint 0 and link like any other.
    Repeated rows stay repeated; rows with a null id take part, and a component
    without any id has a null ``component``. An empty table gives no rows. Extra
    columns are not read, whatever their names. A text is never cut, however long.
    """
    fp = materialize(fingerprints(docs, id_col, text_col, width), "fp")
    nodes = materialize(fp.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    linked = components(trie_links(nodes.select("fp"), budget, limit))
    return _named(fp, nodes, linked).select("id", "fp", "component")


#: Bits of a long fingerprint and of its segments, and the budget of a segment.
LONG, SEGMENT, BUDGET = 192, 32, 2
#: Buckets in which shingles are counted, the slices they are added up in, and pairs a row of shared shingles up to
#: which all pairs are taken.
BUCKETS, SLICES, PAIRS = 1 << 18, 64, 8
#: Shingles before one at which it is told whether a pair has come already.
PAST = 6
#: Bytes of shingle sets of one side that meet those of the other in one task.
CELL = 16 << 20
#: Bits of the parities of a set, and the columns that hold them.
PARITY = 1024
PARITIES = [f"b{i}" for i in range(PARITY // 64)]


def shingle_sets(batch: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``width``-word shingles of each text, in order of text and hash, and the texts' bounds in them.

    Words and short texts are as in ``simhash_text``; a text without words has none.
    """
    n = len(batch)
    if not n:
        return np.zeros(0, U), np.zeros(1, np.int64)
    points, starts = code_points(batch)
    points = np.where((points >= 65) & (points <= 90), points + np.uint32(32), points)
    words = Words(points, starts, ~is_space(points))
    h, doc = words.hashes(), words.doc
    count = np.bincount(doc, minlength=n)
    left = (np.cumsum(count))[doc] - np.arange(len(doc))  # words from here to the end of the text
    first = np.arange(len(doc)) == (np.cumsum(count) - count)[doc]
    begins = np.flatnonzero((left >= width) | first)
    term = np.zeros(len(begins), np.uint64)
    for i in range(width):
        at = begins + i
        there = left[begins] > i
        term = mix(term * U(31) + np.where(there, h[np.minimum(at, len(h) - 1)], U(0)) + U(i + 1))
    owner = doc[begins]
    order = np.lexsort((term, owner))
    term, owner = term[order], owner[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
    return term[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))])


def long_fingerprints(batch: list[str], width: int = 5) -> np.ndarray:
    """(texts, 3) words of 64 bits: SimHash over the distinct ``width``-word shingles; without words all bits are 0."""
    return _long(*shingle_sets(batch, width))


def _long(term: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    votes = np.diff(bounds)
    owner = np.repeat(np.arange(n), votes)
    out = np.zeros((n, LONG), np.uint8)
    ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)
    for word in range(LONG // 64):
        value = mix(term + U((word + 1) * 0xD1342543DE82EF95 % (1 << 64))).view(np.uint8).reshape(-1, 8)
        for i in range(8):
            set_ = np.bincount(owner * 256 + value[:, i], minlength=n * 256).reshape(n, 256).astype(np.float32) @ ones
            at = word * 64 + i * 8
            out[:, at : at + 8] = 2 * set_ > votes[:, None]
    return np.packbits(out, axis=1).view(">u8").astype(U)


def parities(term: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, PARITY / 64) words: a bit is set where an odd number of a set's shingles fall on it.

    A shingle that only one of two sets has turns one bit, so the sets differ in at
    least as many shingles as their parities differ in bits.
    """
    n = len(bounds) - 1
    at = (mix(term + U(0xA5A5)) % U(PARITY)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(n), np.diff(bounds)) * PARITY + at, minlength=n * PARITY).reshape(n, PARITY) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(">u8").astype(U)


def _may_be_alike(one: str, two: str, share: Fraction) -> Column:
    """False for pairs that parities and sizes show to be below ``share``; none at or above it is lost."""
    p, q = share.numerator, share.denominator
    n, m = F.col(f"n{one}"), F.col(f"n{two}")
    differ = sum((F.bit_count(F.col(f"{b}{one}").bitwiseXOR(F.col(f"{b}{two}"))) for b in PARITIES[1:]), F.bit_count(F.col(f"b0{one}").bitwiseXOR(F.col(f"b0{two}"))))
    return (n * q >= m * p) & (m * q >= n * p) & (differ * (p + q) <= (n + m) * (q - p))


def bits_apart(similarity: float, bits: int = LONG) -> int:
    """Bits in which texts of a set similarity (Jaccard) are expected to differ."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5, limit: int = NODE_LIMIT) -> DataFrame:
    """One row per input row: ``(id, component)``, texts of a similarity of at least ``similarity`` linked.

    The similarity is the Jaccard of the sets of ``width``-word shingles (of their
    64-bit hashes), counted for every link. First candidates are pairs whose
    fingerprints of 192 bits agree in all but 2 bits of a segment of 32 and differ, in
    128 bits, little more than texts of that similarity are expected to; they put most
    of a group together. Pairs whose sets must differ in too many shingles, as their
    parities show, are left out. All pairs of different groups that share one of their rarest
    shingles follow, so none is missed. Equal sets are one class. Null and empty texts
    are alike. ``component`` is the smallest id of the group; repeated rows and rows
    without an id stay, and a group without any id has a null ``component``. A text is
    never cut, however long: its set is held by one task at a time. An empty table
    gives no rows; extra columns are not read.
    """
    keyed, base = _keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", "_rid")
    made, classes = _similar(base, similarity, width, limit)
    names = materialize(keyed.select("_rid", "id"), "names")
    rows = names.join(made.join(classes, "fp").select("doc", "component"), F.col("_rid") == F.col("doc")).select("id", "component")
    first = names.select(F.col("_rid").alias("component"), F.col("id").alias("least"))
    return rows.join(first, "component").select("id", F.col("least").alias("component"))


def _similar(base: DataFrame, similarity: float, width: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """``(doc, fp)`` of all rows of ``base(doc, text)``, whose ``doc`` is unique; and ``(fp, component)``, the least doc of a group."""
    small_batches(base.sparkSession)
    share = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(BUCKETS, np.int32)
        for b in cut(batches):
            term, bounds = shingle_sets(texts(b.column(1)), width)
            words = np.hstack([_long(term, bounds), parities(term, bounds)]).view(np.int64)
            full += np.bincount(_buckets(term), minlength=BUCKETS).astype(np.int32)
            none = [pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(_set_hashes(term, bounds)), pa.array(np.diff(bounds)), *[pa.array(np.ascontiguousarray(w)) for w in words.T], *none], names=names)
        if full.any():  # how full the buckets are, beside the rows
            none = [pa.nulls(SLICES, pa.int64())] * (len(names) - 2)
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(full, SLICES)], pa.binary())], names=names)
        trim()

    words = ["w0", "w1", "w2", *PARITIES]
    names = ["doc", "fp", "n", *words, "slice", "full"]
    made = materialize(base.mapInArrow(run, ", ".join(f"{c} long" for c in names[:-2]) + ", slice int, full binary"), "made")
    fullness = _fullness(made.filter("slice is not null").select("slice", "full"))
    rows = made.filter("slice is null")
    nodes = rows.groupBy("fp").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("n", *words)])
    nodes = materialize(nodes, "nodes")
    sets = _Sets(base, nodes, width, share)
    near = _near_pairs(nodes, similarity, limit)
    links = sets.verified(sets.likely(near))
    discard(near)
    rare = _rare_shingles(base, fullness, width, share)
    links = _completed(links, rare, sets)
    discard(rare)
    linked = components(links)
    discard(links)
    least = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "doc", F.coalesce("label", "fp").alias("label"))
    n = nodes.count()
    least = materialize(least, "least", n)
    first = least.groupBy("label").agg(F.min("doc").alias("component"))
    classes = materialize(least.join(first, "label").select("fp", "component"), "classes", n)
    for done in (nodes, least, linked):
        discard(done)
    _release(classes)
    return rows.select("doc", "fp"), classes


def _set_hashes(term: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of each set of shingles, as a signed integer."""
    return np.array([xxhash.xxh64_intdigest(term[x:y].tobytes()) for x, y in zip(bounds, bounds[1:])], np.uint64).view(np.int64)


def _near_pairs(nodes: DataFrame, similarity: float, limit: int) -> DataFrame:
    """Candidate links ``(a, b)`` between classes ``nodes(fp, w0, w1, w2)`` whose fingerprints are near, a forest of them.

    A node with more than ``limit`` classes is dealt by further bits, without pairs of
    children, as candidates need not be complete.
    """
    parts = BUDGET + 1
    edge = [SEGMENT * r // parts for r in range(parts + 1)]
    ones = (1 << SEGMENT) - 1
    segments = [part for w in ("w0", "w1", "w2") for part in (F.shiftrightunsigned(w, SEGMENT), F.col(w).bitwiseAND(ones))]
    rows = []
    for i in range(len(segments)):
        rest = [segments[(i + k) % len(segments)] for k in (1, 2, 3)]
        for r in range(parts):
            turned = F.shiftleft(segments[i], edge[r]).bitwiseOR(F.shiftrightunsigned(segments[i], SEGMENT - edge[r])).bitwiseAND(ones) if r else segments[i]
            each = edge[r + 1] - edge[r]
            path = F.shiftleft(turned, SEGMENT).bitwiseOR(rest[0])
            more = F.shiftleft(rest[1], SEGMENT).bitwiseOR(rest[2])
            node = F.shiftrightunsigned(turned, SEGMENT - each)
            rows.append(F.struct(F.lit(i * parts + r).alias("tab"), F.lit(each).alias("depth"), node.alias("a"), node.alias("b"), F.lit(0).alias("side"), path.alias("path"), more.alias("more")))
    work = nodes.select("fp", F.explode(F.array(*rows)).alias("r")).select("r.*", F.col("fp").alias("id"))
    work = _split(materialize(work.select(*KEY, "side", "path", "id", "more"), "work"), 0, limit)
    found = materialize(_walked(work, BUDGET, SEGMENT, bits_apart(similarity, 4 * SEGMENT) + 2), "near")
    discard(work)
    _release(found)
    return found


def _fullness(slices: DataFrame) -> np.ndarray:
    """Counts of all buckets, from ``(slice, full)`` of all tasks; added up in parts first, and then all."""

    def adding(kind):
        def total(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(x, kind).astype(np.int64) for x in group.column("full").to_pylist())
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "full": pa.array([sums.tobytes()], pa.binary())})

        return total

    parts = slices.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(1024))).groupBy("slice", "part")
    some = materialize(parts.applyInArrow(adding(np.int32), "slice int, full binary"), "tally")
    found = sorted(some.groupBy("slice").applyInArrow(adding(np.int64), "slice int, full binary").collect())
    discard(some)
    return np.concatenate([np.frombuffer(r["full"], np.int64) for r in found]) if found else np.zeros(BUCKETS, np.int64)


def _rare_shingles(base: DataFrame, fullness: np.ndarray, width: int, share: Fraction) -> DataFrame:
    """``(h, fp, n, at)``: shingles ``h`` that a Jaccard of ``share`` cannot do without, rarest first, where two classes have them.

    A set's ``n`` shingles are in order of how full their bucket of ``BUCKETS`` is;
    ``at`` is the place in that order. Any order of all shingles gives the same links.
    """
    shared = base.sparkSession.sparkContext.broadcast(fullness)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes this task has sent
        for b in cut(batches):
            h, bounds = shingle_sets(texts(b.column(0)), width)
            fp, n = _set_hashes(h, bounds), np.diff(bounds)
            fresh_ = np.zeros(len(fp), bool)
            for i, x in enumerate(fp.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh_[i] = True
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, shared.value[_buckets(h)], owner))
            at = np.arange(len(h)) - np.repeat(bounds[:-1], n)
            keep = fresh_[owner] & (at <= (n + -n * share.numerator // share.denominator)[owner])
            owner = owner[keep]
            cols = [pa.array(h[order][keep].view(np.int64)), pa.array(fp[owner]), pa.array(n[owner].astype(np.int32)), pa.array(at[keep].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["h", "fp", "n", "at"])
        trim()

    found = base.select("text").mapInArrow(prefixes, "h long, fp long, n int, at int").repartition(partitions(base.sparkSession), "h")
    among = Window.partitionBy("h")
    found = found.withColumn("lo", F.min("fp").over(among)).withColumn("hi", F.max("fp").over(among))
    rare = materialize(found.filter("lo < hi").select("h", "fp", "n", "at").dropDuplicates(["h", "fp"]), "rare")
    found = None
    _release(rare)
    return rare


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h % U(BUCKETS)).astype(np.int64)


def _completed(links: DataFrame, rare: DataFrame, sets: _Sets) -> DataFrame:
    """``links`` and what is missing of the links ``rare`` shows, so that all of them are joined.

    While shingles are shared by many pairs of classes in different groups, each class
    is held against one hub of each of its shingles, which puts a crowd into few groups
    without all its pairs; as long as that halves them, so that rounds are few. Then all
    pairs of different groups that are left are taken: each class outside the largest
    group of a shingle with all classes of others.
    """
    size, turn, before = rare.count(), 0, float("inf")
    p, q = sets.share.numerator, sets.share.denominator
    while True:
        groups = components(links)
        label = F.coalesce("label", "fp").alias("label")
        own = materialize(rare.join(groups, rare.fp == groups.node, "left").select("h", "fp", "n", "at", label), "own", size)
        per = own.groupBy("h", "label").agg(F.count("*").cast("double").alias("c"))
        mixed = per.groupBy("h").agg(F.count("*").alias("k"), F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        mixed = materialize(mixed.filter("k > 1").select("h", F.col("top.label").alias("top"), ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs")), "mixed", size)
        left = mixed.agg(F.sum("pairs")).head()[0] or 0
        hubs = left > PAIRS * size and left <= before / 2
        before = left
        cross = own.join(mixed.select("h", "top"), "h").join(sets.nodes.select("fp", *PARITIES), "fp")
        before_it = Window.partitionBy("fp").orderBy("at").rowsBetween(-PAST, -1)
        cross = materialize(cross.withColumn("past", F.collect_list("h").over(before_it)), "cross", size)
        facts = ("fp", "n", "at", "label", "past", *PARITIES)
        one = cross.select("h", "top", *[F.col(c).alias(f"{c}1") for c in facts])
        two = cross.select("h", *[F.col(c).alias(f"{c}2") for c in facts])
        if hubs:
            first = F.struct(F.xxhash64("fp1", F.lit(turn)).alias("by"), *[f"{c}1" for c in facts])
            one = one.groupBy("h").agg(F.min(first).alias("hub")).select("h", "hub.*").drop("by")
            pairs = one.join(two, "h").filter("label1 <> label2")
        else:
            pairs = one.filter("label1 <> top").join(two, "h").filter("label1 <> label2 and (label2 = top or fp1 < fp2)")
        # a pair comes by the first shingle that both have, and seldom again: not where one shortly before it is shared
        room = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
        pairs = pairs.filter(_may_be_alike("1", "2", sets.share) & (room * (p + q) >= (F.col("n1") + F.col("n2")) * p) & ~F.arrays_overlap("past1", "past2"))
        found = sets.verified(pairs.select(F.col("fp1").alias("a"), F.col("fp2").alias("b"))) if left else None
        for done in (own, mixed, cross, groups):
            discard(done)
        if found is None:
            return links
        links = materialize(links.unionByName(found), "links")
        if not hubs:
            return links
        turn += 1


class _Sets:
    """Shingle sets of classes ``nodes(fp, doc, n, b0, ...)``, made from ``base(doc, text)`` whenever pairs are to be decided.

    Only the texts of classes in some pair (and of the few others that a sketch of
    them takes for one) are worked on again, so no table of all sets is kept and no
    text is shuffled. A set goes to each cell of a grid in which it has a partner, not to
    each partner: classes are dealt to ``side`` parts, and a pair to the cell of its
    two, so that a task holds about ``CELL`` bytes of either side.
    """

    def __init__(self, base: DataFrame, nodes: DataFrame, width: int, share: Fraction):
        self.base, self.nodes, self.width, self.share = base, nodes, width, share

    def _made(self, ends: DataFrame) -> DataFrame:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in cut(batches):
                term, bounds = shingle_sets(texts(b.column(0)), width)
                rows = [term[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(_set_hashes(term, bounds)), pa.array(rows, pa.binary())], names=["fp", "shingles"])
            trim()

        need = materialize(sketch(self.nodes.join(ends, "fp", "left_semi").select("doc")), "need", SKETCH // WORD)
        made = materialize(sketched(self.base, "doc", need, keep=True).select("text").mapInArrow(run, "fp long, shingles binary"), "sets")
        discard(need)
        return made

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` that parities and sizes do not rule out."""
        facts = ("n", *PARITIES)
        one, two = (self.nodes.select(F.col("fp").alias(c), *[F.col(x).alias(f"{x}{c}") for x in facts]) for c in ("a", "b"))
        return pairs.join(one, "a").join(two, "b").filter(_may_be_alike("a", "b", self.share)).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` whose sets have a Jaccard of at least ``share``."""
        pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        made = self._made(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
        side = int((made.agg(F.sum(F.length("shingles"))).head()[0] or 0) // CELL) + 1
        p, q = self.share.numerator, self.share.denominator

        def check(some: pa.Table, sets: pa.Table) -> pa.Table:
            held = {fp.as_py(): np.frombuffer(x.as_buffer(), U) for fp, x in zip(sets["fp"], sets["shingles"])}
            a, b = some["a"].to_pylist(), some["b"].to_pylist()
            good = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a, b)):
                x, y = held[x], held[y]
                if len(x) > len(y):
                    x, y = y, x
                if len(x) * q >= len(y) * p and len(x):
                    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
                    good[i] = both * q >= p * (len(x) + len(y) - both)
            return pa.table({"a": pa.array(np.array(a, np.int64)[good]), "b": pa.array(np.array(b, np.int64)[good])})

        at = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
        dealt = pairs.withColumn("cell", at("a") * side + at("b"))
        wanted = dealt.select(F.explode(F.array(F.struct(F.col("a").alias("fp"), "cell"), F.struct(F.col("b").alias("fp"), "cell"))).alias("x")).select("x.*").distinct()
        wanted = made.join(wanted.hint("merge"), "fp").select("cell", "fp", "shingles")
        links = materialize(dealt.groupBy("cell").cogroup(wanted.groupBy("cell")).applyInArrow(check, "a long, b long"), "links")
        for done in (pairs, made):
            discard(done)
        _release(links)
        return links


def _release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of frames that are gone; it does so when the driver's JVM collects them."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _named(fp: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows of ``fp`` with the smallest id of their fingerprint's component."""
    classes = nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    classes = materialize(classes, "classes")
    first = materialize(classes.groupBy("label").agg(F.min("least").alias("component")), "first")
    named = materialize(classes.join(first, "label").select("fp", "component"), "named")
    return fp.join(named, "fp")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """``docs`` with one document of each group of ``similar_groups``: that with the smallest id.

    Columns are those of ``docs``, clashing names included. A document alone in its
    group stays, whether its id is repeated or null; in a group a row without an id
    stays only if no row has one, and of rows that share the smallest id that with the
    smallest hash of its text. Texts without words (null ones too) are one group. An
    empty table gives no rows.
    """
    rid, key = fresh(docs, "_rid", "_kept")
    keyed, base = _keyed(docs, id_col, text_col, rid)
    made, classes = _similar(base, similarity, width, NODE_LIMIT)
    keep = materialize(classes.select(F.col("component").alias(key)).distinct(), "keep", classes.count())
    gone = materialize(sketch(made.join(keep, F.col("doc") == F.col(key), "left_anti").select("doc")), "gone", SKETCH // WORD)
    calm = sketched(keyed, rid, gone, keep=False)
    rest = sketched(keyed, rid, gone, keep=True).join(keep.hint("merge"), F.col(rid) == F.col(key), "left_semi")  # dropped, or taken for one
    return calm.unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns])
