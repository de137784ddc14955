"""Token ids as bit-plane files.

A dataset is a folder of Parquet records, each a chunk of whole documents in
ascending id order. A chunk's ids are cut into blocks of a fixed size; each block
is transposed into planes (all lowest bits, all second bits, ... or all lowest
bytes, ...), and each plane is compressed by zstandard on its own. The chunk's
index holds the compressed size of every plane and the id, place and length of
every document, so a document or block can be read without the others.

High planes are nearly constant and shrink to almost nothing; low planes are
close to noise and are kept at their size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, small_batches, texts
from .ranges import id_bounds, range_of
from .tokens import encoder

BLOCK = 1 << 14
#: A chunk is closed at the first document end beyond so many ids.
CHUNK = 1 << 17
LEVEL = 1

SCHEMA = "shard int, chunk int, first long, n_ids long, width int, plane string, block int, plane_sizes array<int>, doc_ids array<long>, doc_lengths array<long>, data binary"


def encode_planes(ids: np.ndarray, plane: str = "bit", block: int = BLOCK, width: int | None = None) -> tuple[bytes, list[int], int]:
    """All planes of all blocks in a row, their compressed sizes, and the bits or bytes of an id."""
    ids = ids.astype("<u4")
    if width is None:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        width = bits if plane == "bit" else (bits + 7) // 8
    press = zstandard.ZstdCompressor(level=LEVEL)
    out, sizes = [], []
    for i in range(0, len(ids), block):
        raw = np.ascontiguousarray(ids[i : i + block].view(np.uint8).reshape(-1, 4))
        if plane == "bit":
            rows = np.unpackbits(raw[:, : (width + 7) // 8], axis=1, bitorder="little")[:, :width]
            planes = np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little")
        else:
            planes = np.ascontiguousarray(raw[:, :width].T)
        for p in planes:
            data = press.compress(p.tobytes())
            out.append(data)
            sizes.append(len(data))
    return b"".join(out), sizes, width


def decode_planes(data: bytes, sizes: list[int], width: int, n_ids: int, plane: str = "bit", block: int = BLOCK) -> np.ndarray:
    """The ids that ``encode_planes`` was given, as uint32."""
    spread = zstandard.ZstdDecompressor()
    out = np.zeros(n_ids, "<u4")
    at, k = 0, 0
    for i in range(0, n_ids, block):
        n = min(block, n_ids - i)
        per = (n + 7) // 8 if plane == "bit" else n
        planes = np.zeros((width, per), np.uint8)
        for j in range(width):
            planes[j] = np.frombuffer(spread.decompress(data[at : at + sizes[k]], max_output_size=per), np.uint8)
            at += sizes[k]
            k += 1
        if plane == "bit":
            bits = np.unpackbits(planes, axis=1, bitorder="little")[:, :n].T
            full = np.zeros((n, 32), np.uint8)
            full[:, :width] = bits
            out[i : i + n] = np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()
        else:
            raw = np.zeros((n, 4), np.uint8)
            raw[:, :width] = planes.T
            out[i : i + n] = raw.view("<u4").ravel()
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, plane: str = "byte", block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text (null: empty), append ``end_id`` to each, and write all in ascending id order to ``path``.

    Rows without an id come last; rows that repeat an id follow one another by a
    hash of their texts. An empty table writes no record. Extra columns are not read.
    A text is encoded whole, however long. As the order is by id, all rows without one,
    or with one and the same, are one range and stream through one task.
    """
    if plane not in ("bit", "byte"):
        raise ValueError("plane must be 'bit' or 'byte'")
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shard = range_of(id_bounds(base, "id"), null_high=True)
    dealt = base.select(shard("id").alias("shard"), "id", "text").repartition(partitions(spark), "shard")
    dealt = dealt.sortWithinPartitions("shard", F.col("id").asc_nulls_last(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        open_: _Chunk | None = None
        for b in cut(batches):
            ids, counts = enc.encode(texts(b.column(2)))
            ends = np.cumsum(counts)
            for i, (s, d) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if open_ is None or open_.shard != s:
                    if open_ is not None:
                        yield open_.record(plane, block)
                    open_ = _Chunk(s, 0, 0)
                elif open_.n >= CHUNK:
                    yield open_.record(plane, block)
                    open_ = _Chunk(s, open_.chunk + 1, open_.first + open_.n)
                open_.add(d, ids[ends[i] - counts[i] : ends[i]], end_id)
        if open_ is not None:
            yield open_.record(plane, block)

    dealt.mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


class _Chunk:
    def __init__(self, shard: int, chunk: int, first: int):
        self.shard, self.chunk, self.first = shard, chunk, first
        self.n, self.ids, self.docs, self.lengths = 0, [], [], []

    def add(self, doc: int | None, ids: np.ndarray, end_id: int | None) -> None:
        self.ids.append(ids)
        if end_id is not None:
            self.ids.append(np.array([end_id], np.uint32))
        n = len(ids) + (end_id is not None)
        self.n += n
        self.docs.append(doc)
        self.lengths.append(n)

    def record(self, plane: str, block: int) -> pa.RecordBatch:
        ids = np.concatenate([x.astype(np.uint32) for x in self.ids]) if self.ids else np.zeros(0, np.uint32)
        data, sizes, width = encode_planes(ids, plane, block)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        row = [self.shard, self.chunk, self.first, len(ids), width, plane, block, sizes, self.docs, self.lengths, data]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[f.split(" ")[0] for f in SCHEMA.split(", ")])


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a folder that ``write`` made: ``(doc_id, start, n_tokens, ids_crc32[, ids])``.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the
    unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers. One number
    per shard reaches the driver, as the shards' starts.
    """
    chunks = spark.read.schema(SCHEMA).parquet(path)
    total: dict[int, int] = {r.shard: r.n for r in chunks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    start, at = {}, 0
    for s in sorted(total):
        start[s] = at
        at += total[s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield _documents(b.slice(i, 1).to_pylist()[0], start, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return chunks.mapInArrow(run, schema)


def _documents(r: dict, start: dict[int, int], with_ids: bool) -> pa.RecordBatch:
    ids = decode_planes(r["data"], r["plane_sizes"], r["width"], r["n_ids"], r["plane"], r["block"])
    ends = np.cumsum(np.array(r["doc_lengths"], np.int64))
    begins = ends - r["doc_lengths"]
    raw = ids.tobytes()
    view = memoryview(raw)
    crc = [zlib.crc32(view[4 * a : 4 * e]) for a, e in zip(begins.tolist(), ends.tolist(), strict=True)]
    cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(begins + (start[r["shard"]] + r["first"])), pa.array(r["doc_lengths"], pa.int64()), pa.array(crc, pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        cols.append(pa.array([ids[a:e].astype(np.int64) for a, e in zip(begins, ends, strict=True)], pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names=names)
