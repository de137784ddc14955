"""Vector bin packing of examples into training sequences.

Each example weighs on three limits at once: tokens, segments and loss-bearing
tokens. A sequence is filled by the dot-product rule: of the examples that still
fit, take the one whose needs, each as a share of its limit, have the largest dot
product with what the sequence has left. Examples of equal needs form a class, so
a choice looks at classes, not at examples.

Where examples may be cut, one that does not fit is cut to fill the sequence, and
the last, partly filled sequences are cut to lengths that are powers of two, which
need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut as cut_batches
from .common import small_batches, texts, trim
from .tokens import encoder, release

#: Ids that a task gathers before it packs them; what does not fill a sequence is carried on.
WINDOW = 4 << 20


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 4096
    loss: int = 4096


class _Line:
    """Classes whose tokens all bear loss, as sorted sizes: a larger one has the larger dot product with any room."""

    def __init__(self):
        self.sizes: list[int] = []

    def add(self, tokens: int, loss: int) -> None:
        insort(self.sizes, tokens)

    def drop(self, tokens: int, loss: int) -> None:
        del self.sizes[bisect_left(self.sizes, tokens)]

    def best(self, left: tuple[int, int, int]) -> tuple[int, int, bool]:
        at = bisect_right(self.sizes, left[0])
        n = self.sizes[at - 1]  # the largest of all where none fits
        return n, n, at > 0


class _Table:
    """Any classes, as rows of needs; all are scored at once."""

    def __init__(self, limits: Limits):
        self.full = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.need = np.zeros((64, 3))
        self.live = np.zeros(64, bool)
        self.row: dict[tuple[int, int], int] = {}
        self.free = list(range(63, -1, -1))

    def add(self, tokens: int, loss: int) -> None:
        if not self.free:
            n = len(self.live)
            self.need, self.live = np.vstack([self.need, np.zeros((n, 3))]), np.append(self.live, np.zeros(n, bool))
            self.free = list(range(2 * n - 1, n - 1, -1))
        i = self.row[tokens, loss] = self.free.pop()
        self.need[i], self.live[i] = (tokens, 1, loss), True

    def drop(self, tokens: int, loss: int) -> None:
        i = self.row.pop((tokens, loss))
        self.live[i] = False
        self.free.append(i)

    def best(self, left: tuple[int, int, int]) -> tuple[int, int, bool]:
        score = (self.need / self.full) @ (np.array(left) / self.full)
        fits = self.live & (self.need <= left).all(axis=1)
        found = bool(fits.any())
        i = int(np.argmax(np.where(fits if found else self.live, score, -1.0)))
        return int(self.need[i, 0]), int(self.need[i, 2]), found


class Packer:
    """Fills sequences from examples added one by one. ``take`` gives the pieces of full sequences.

    An example is ``(key, tokens, loss)``: its last ``loss`` tokens bear loss. A
    piece is ``(key, start, length, sequence, offset)``. Classes of equal needs are
    kept from sequence to sequence.
    """

    def __init__(self, limits: Limits, cut: bool):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits must be at least 1")
        self.limits, self.cut = limits, cut
        self.waiting: dict[tuple[int, int], list[tuple]] = {}
        self.classes: _Line | _Table = _Line() if limits.loss >= limits.tokens else _Table(limits)
        self.tokens = 0
        self.sequence = 0

    def add(self, key, tokens: int, loss: int) -> None:
        if loss > tokens or min(tokens, loss) < 0:
            raise ValueError(f"example {key}: {loss} of {tokens} tokens bear loss")
        if not self.cut and (tokens > self.limits.tokens or loss > self.limits.loss):
            raise ValueError(f"example {key} with {tokens} tokens, {loss} with loss, exceeds the limits and may not be cut")
        if tokens:
            self._put(key, 0, tokens, loss)

    def _put(self, key, start: int, tokens: int, loss: int) -> None:
        if loss < tokens and isinstance(self.classes, _Line):
            self.classes = _Table(self.limits)
            for c in self.waiting:
                self.classes.add(*c)
        held = self.waiting.get((tokens, loss))
        if held is None:
            held = self.waiting[tokens, loss] = []
            self.classes.add(tokens, loss)
        held.append((key, start))
        self.tokens += tokens

    def take(self, all_: bool = False) -> Iterator[tuple]:
        """Pieces of sequences, as long as what waits can fill one; with ``all_`` until nothing waits."""
        while self.waiting and (all_ or self.tokens >= self.limits.tokens):
            room = self.limits.tokens
            if self.cut and self.tokens < room:
                room = 1 << (self.tokens.bit_length() - 1)
            yield from self._fill(room)

    def _fill(self, room: int) -> Iterator[tuple]:
        left = (room, self.limits.segments, self.limits.loss)
        offset = 0
        while left[0] > 0 and left[1] > 0 and self.waiting:
            tokens, loss, fits = self.classes.best(left)
            size, rest_loss = tokens, 0
            if not fits:
                size = min(left[0], tokens, tokens - loss + left[2])
                if not self.cut or size <= 0:
                    break
                rest_loss = min(loss, tokens - size)
            key, start = self._pop(tokens, loss)
            if size < tokens:
                self._put(key, start + size, tokens - size, rest_loss)
            yield key, start, size, self.sequence, offset
            offset += size
            left = (left[0] - size, left[1] - 1, left[2] - (loss - rest_loss))
        self.sequence += 1

    def _pop(self, tokens: int, loss: int) -> tuple:
        held = self.waiting[tokens, loss]
        key, start = held.pop()
        if not held:
            del self.waiting[tokens, loss]
            self.classes.drop(tokens, loss)
        self.tokens -= tokens
        return key, start


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", pieces: int | None = None) -> DataFrame:
    """Pieces of all documents in sequences: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    Every text (null: empty) is encoded whole and ended by ``end_id``; all its ids
    bear loss. A document is cut where that fills a sequence. Each task packs its own
    documents, a window at a time, in the order they come; ``sequence_id`` is the
    task's number shifted by 40 bits plus a count, so a task that is run again gives
    the same. Rows without an id and rows that repeat one are packed like others. An
    empty table gives no rows. Extra columns are not read. A long text is encoded whole
    and cut only where sequences end. ``pieces`` bounds the
    encoder's table and has it dropped after each task, where other stages need a
    worker's memory too.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, pieces)
        packer = Packer(limits, cut=True)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, tuple] = {}
        n = 0
        for b in cut_batches(batches):
            ids, counts = enc.encode(texts(b.column(1)))
            ends = np.cumsum(counts)
            for i, d in enumerate(b.column(0).to_pylist()):
                own = np.append(ids[ends[i] - counts[i] : ends[i]], np.array(end_id, ids.dtype))
                held[n] = (d, own)
                packer.add(n, len(own), len(own))
                n += 1
            if packer.tokens >= WINDOW:
                yield from _pieces(packer.take(), held, base)
                waiting = {key for group in packer.waiting.values() for key, _ in group}
                held = {k: held[k] for k in waiting}
        yield from _pieces(packer.take(all_=True), held, base)
        if pieces is not None:
            del enc
            release()
            trim()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema)


def _pieces(taken: Iterator[tuple], held: dict[int, tuple], base: int) -> Iterator[pa.RecordBatch]:
    rows = []
    for key, start, length, sequence, offset in taken:
        doc, ids = held[key]
        crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
        rows.append((doc, start, length, crc, len(ids), base + sequence, offset))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack_examples(examples: DataFrame, limits: Limits, cut: bool = False, key: str = "id", tokens: str = "tokens", loss: str = "loss") -> DataFrame:
    """Pieces ``(key, start, length, sequence_id, offset)`` of examples whose token and loss counts are given.

    For instruction data: the last ``loss`` of an example's ``tokens`` bear loss, and
    without ``cut`` every example stays whole (one that exceeds a limit raises). Null
    counts are 0; examples without tokens get no piece. Repeated and null keys are
    examples like others, an empty table gives no rows, extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut)
        base = TaskContext.get().partitionId() << 40
        kind = None

        def out(taken):
            rows = [(k, s, n, base + q, o) for k, s, n, q, o in taken]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), kind), *[pa.array(list(c), pa.int64()) for c in cols[1:]]], names=["key", "start", "length", "sequence_id", "offset"])

        for b in cut_batches(batches):
            kind = b.column(0).type
            for k, t, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                packer.add(k, t or 0, s or 0)
            if packer.tokens >= WINDOW:
                yield from out(packer.take())
        yield from out(packer.take(all_=True))

    kind = examples.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, sequence_id long, offset long"
    return examples.select(key, F.col(tokens).cast("long"), F.col(loss).cast("long")).mapInArrow(run, schema)
