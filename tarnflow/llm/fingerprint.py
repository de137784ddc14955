"""Document fingerprints: SimHash of weighted terms, and a search by permuted block tables.

Terms are the word pairs of a text (a lone word is its own term), each weighted
by 1 + ln of how often it occurs there. Every term's hash votes with its weight
for or against each of the 128 bits.

Search: cut the 128 bits into radius + 1 blocks. Fingerprints within the radius
agree in at least one block, so one table per block, keyed by the block, meets
every pair; the full distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, materialize, partitions, small_batches, texts
from .ranges import id_bounds, range_of
from .terms import U, Words, code_points, is_space, mix

BITS = 128


def simhash_batch(batch: list[str]) -> np.ndarray:
    """(texts, 16) bytes: the fingerprint of each text; a text without words has all bits 0."""
    n = len(batch)
    if not n:
        return np.zeros((0, BITS // 8), np.uint8)
    points, starts = code_points([t.lower() for t in batch])
    words = Words(points, starts, ~is_space(points))
    h, doc = words.hashes(), words.doc
    pair = doc[1:] == doc[:-1]
    term = np.concatenate([mix(h[:-1][pair] * U(3) + h[1:][pair]), h[np.bincount(doc, minlength=n)[doc] == 1]])
    owner = np.concatenate([doc[:-1][pair], doc[np.bincount(doc, minlength=n)[doc] == 1]])
    own = mix(owner.astype(U) + U(77))
    _, at, tf = np.unique(term ^ own, return_index=True, return_counts=True)
    term, owner = term[at], owner[at]
    weight = np.rint(64 * (1 + np.log(tf)))  # whole numbers, so that sums do not depend on their order
    out = np.zeros((n, BITS), np.uint8)
    signs = 2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1
    for half in range(BITS // 64):
        value = mix(term + U((half + 1) * 0xD1342543DE82EF95 % (1 << 64))).view(np.uint8).reshape(-1, 8)
        for i in range(8):
            votes = np.bincount(owner * 256 + value[:, i], weights=weight, minlength=n * 256).reshape(n, 256) @ signs
            at_bit = half * 64 + i * 8
            out[:, at_bit : at_bit + 8] = votes > 0
    return np.packbits(out, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that the share of differing bits stands for, not below 0; equal ones give 1."""
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return np.maximum(0.0, np.cos(np.pi * differ / BITS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row, 32 hex digits; null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            fp = simhash_batch(texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes().hex() for x in fp])], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, fingerprint string")


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints in hex."""
    parts = [F.bit_count(F.conv(F.substring(a, 1 + 8 * i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, 1 + 8 * i, 8), 16, 10).cast("long"))) for i in range(BITS // 32)]
    return sum(parts[1:], parts[0])


def within_radius(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """All ``(query, match, differ)`` with at most ``radius`` differing bits (below 32), by permuted block tables.

    Both frames hold ``(id, fingerprint)``. Equal fingerprints are met once, as
    classes: ``query`` and ``match`` are fingerprints, to be joined with the ids
    as needed, so repeated rows and rows without an id do not matter. Null fingerprints
    meet nothing, an empty table gives no rows, extra columns are not read. Pairs grow
    with the number of queries; ask for a stated set, not for all against all.
    """
    digits = BITS // 4
    blocks = radius + 1
    if not 0 < blocks <= digits:
        raise ValueError(f"radius must be from 0 to {digits - 1}")
    ends = [digits * i // blocks for i in range(blocks + 1)]

    def tabled(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("fingerprint").alias(name)).filter(f"{name} is not null").distinct()
        keys = [F.struct(F.lit(i).alias("t"), F.substring(name, ends[i] + 1, ends[i + 1] - ends[i]).alias("block")) for i in range(blocks)]
        return materialize(one.select(name, F.explode(F.array(*keys)).alias("k")).select(name, "k.t", "k.block"), "tables")

    pairs = tabled(queries, "query").join(tabled(prints, "match"), ["t", "block"])
    pairs = pairs.withColumn("differ", distance(F.col("query"), F.col("match"))).filter(F.col("differ") <= radius)
    return pairs.select("query", "match", "differ").distinct()


def near_counts(prints: DataFrame, radius: int, every: int = 100) -> DataFrame:
    """``(id, n_within)``: for each row of ``prints(id, fingerprint)`` whose id is divisible by ``every``, how many other rows' fingerprints differ in at most ``radius`` bits.

    Copies are one class with a count; a query set against all rows, not all pairs.
    Rows without an id are counted but ask nothing; ids that repeat ask once for each
    of their fingerprints.
    """
    classes = materialize(prints.groupBy("fingerprint").agg(F.count("*").alias("copies")), "classes")
    asking = prints.filter(F.col("id") % every == 0).select("id", "fingerprint").distinct()
    pairs = within_radius(asking, classes, radius)
    sums = pairs.join(classes, pairs.match == classes.fingerprint).groupBy("query").agg((F.sum("copies") - 1).alias("n_within"))
    return asking.join(sums, asking.fingerprint == sums.query).select("id", "fingerprint", "n_within")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, and how like they and the next text's are.

    The next document is that with the next smaller id, after the last the first;
    the edited text has the second half (rounded down, in code points) replaced by
    the next text's first as many, or all it has. Null texts count as empty. Null ids
    come last; rows that repeat an id follow one another in order of a hash of their
    texts. Alone, a document is its own next. An empty table gives no rows.

    Neighbours meet without a sort of the whole table: ids are dealt in ranges, and
    the first text of each range is also sent to the range that precedes it. All rows
    without an id, or with one and the same, are one range, and so one task: their
    texts stream through it one after the other. A text is never cut, however long.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    number = range_of(id_bounds(base, "id"), null_high=False)
    tops = {r.r: r.top for r in base.select("id").withColumn("r", number("id")).groupBy("r").agg(F.max("id").alias("top")).collect()}
    held = sorted(r for r, top in tops.items() if top is not None)
    # the largest id of a range is the next document of the smallest id in the range above; that of the last range closes the ring
    guest = {tops[r]: (held[i + 1] if i + 1 < len(held) else min(tops)) for i, r in enumerate(held)}
    if guest:
        known = F.create_map(*[x for k, v in guest.items() for x in (F.lit(k), F.lit(v))])
        also = F.when(F.col("id").isin(list(guest)), known[F.col("id")])
    else:
        also = F.lit(None).cast("int")
    seats = F.array(F.struct(F.col("home").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("also").alias("r"), F.lit(1).alias("guest")))
    dealt = base.withColumn("home", number("id")).withColumn("also", also)
    dealt = dealt.select("id", "text", F.explode(F.filter(seats, lambda s: s.r.isNotNull())).alias("s")).select("s.r", "s.guest", "id", "text")
    dealt = dealt.repartition(partitions(spark), "r").sortWithinPartitions("r", "guest", F.col("id").desc_nulls_last(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: tuple | None = None
        for b in cut(batches):
            yield from _neighbours(wait, b)
            last = b.num_rows - 1
            wait = tuple(b.column(i)[last].as_py() for i in range(4))
        if wait is not None and not wait[1]:
            yield from _neighbours(wait, None)

    return dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _neighbours(wait: tuple | None, b: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    """Rows of those whose next one is here: ``wait`` (the row before ``b``) and all of ``b`` but its last."""
    rows = [[x] for x in wait] if wait is not None else [[], [], [], []]
    if b is None:  # no next at all: its own
        rows = [x * 2 for x in rows]
    else:
        for i in range(4):
            rows[i].extend(b.column(i).to_pylist())
    r, guest, ids, text = rows
    pick = [i for i in range(len(r) - 1) if not guest[i]]
    if not pick:
        return
    edited = []
    for i in pick:
        half = len(text[i]) // 2
        following = text[i + 1] if r[i + 1] == r[i] else text[i]
        edited.append(text[i][: len(text[i]) - half] + following[:half])
    fp = simhash_batch(text)
    fp_edited = simhash_batch(edited)
    at = np.array(pick)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([ids[i] for i in pick], pa.int64()),
            pa.array([len(text[i]) for i in pick], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array([fp[i].tobytes().hex() for i in pick]),
            pa.array([x.tobytes().hex() for x in fp_edited]),
            pa.array(likeness(fp[at], fp_edited)),
            pa.array(likeness(fp[at], fp[at + 1])),
        ],
        names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
