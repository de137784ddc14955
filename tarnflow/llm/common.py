"""Shared plumbing: scratch tables in the cluster's shared folder, text access, schemas."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path, shared_dir

#: Rows and bytes of an Arrow batch handed to Python, as texts can be long; and rows and bytes whose texts are worked
#: on at once, so that the arrays made from them stay in a core's cache and a worker stays small. A longer text is
#: worked on alone.
BATCH_ROWS, BATCH_BYTES, CUT_ROWS, CUT_BYTES = 1000, 8 << 20, 128, 1 << 20
#: Bytes of a written table that a task gathers at once.
ROW_GROUP = 16 << 20
#: Rows of a file of a small table.
FILE_ROWS = 250_000
#: Bits, and bits of a word, in which a set of ids is sketched (see ``sketch``).
SKETCH, WORD = 1 << 24, 64


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts lineage).

    The files outlive a lost executor, unlike cached blocks. Where it is known that
    there are at most so many ``rows``, they are written by no more tasks than that
    needs, so that rounds over small tables do not leave thousands of small files.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tarnflow_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a frame that ``materialize`` returned."""
    path = getattr(df, "_tarnflow_path", None)
    if path is None:
        return
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this package in the shared folder; call it once results are written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tarnflow")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array, replace: str = "") -> list[str]:
    """A text column as Python strings, null as ``replace``."""
    return [replace if x is None else x for x in column.to_pylist()]


def cut(batches: Iterable[pa.RecordBatch], rows: int = CUT_ROWS, size: int = CUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, and of ``size`` bytes of text unless a single row has more."""
    for b in batches:
        sizes = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends, i = np.cumsum(sizes), 0
        while i < b.num_rows:
            fits = int(np.searchsorted(ends, ends[i] - sizes[i] + size, side="right"))
            j = max(i + 1, min(i + rows, fits))
            yield b.slice(i, j - i)
            i = j


def trim() -> None:
    """Give memory that a worker has freed back to the system, where its C library can; workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def crc_bucket(column, modulus: int):
    """``crc32(id as text) mod modulus``; null ids fall in bucket -1."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(-1))


def sketch(ids: DataFrame) -> DataFrame:
    """``(word, bits)`` of a one-column frame of ids: a bit for each id, ``SKETCH`` bits at most, so it may be broadcast whatever the ids are."""
    at = F.pmod(F.xxhash64(F.col(ids.columns[0])), F.lit(SKETCH))
    words = ids.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{ids.columns[0]}`), {WORD}) as int))").alias("bit"))
    return words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def sketched(df: DataFrame, column: str, words: DataFrame, keep: bool) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the ids of a ``sketch`` (``keep``), or surely is not; without a shuffle.

    None that is among them is ever missed; some others are taken for them, the more
    the fuller the sketch.
    """
    word, bits = fresh(df, "_word", "_bits")
    held = F.broadcast(words.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    at = F.pmod(F.xxhash64(F.col(column)), F.lit(SKETCH))
    joined = df.join(held, F.shiftright(at, 6) == F.col(word), "inner" if keep else "left")
    hit = F.expr(f"shiftrightunsigned(`{bits}`, cast(pmod(xxhash64(`{column}`), {WORD}) as int)) & 1 = 1")
    return joined.filter(hit if keep else ~F.coalesce(hit, F.lit(False))).drop(word, bits)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df`` (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def vocabulary(name: str) -> str:
    """Where the public tokenizer file ``name`` lies; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

