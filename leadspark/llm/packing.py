"""Packing: vector bin packing by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. Each task packs
the documents it reads. What fills a sequence alone leaves at once; the rest waits in a
pool of bounded size. A new sequence takes, again and again, the waiting example whose
demand vector has the largest dot product with the room that is left, of those that fit
in every dimension. When none fits whole, an example is cut to fill the token room.
Nothing is shuffled, and memory holds one pool, whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty
from .tokens import encoder

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("loss_tokens", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("loss_tokens", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
#: Sequence ids of a task start at its number times this.
TASK_SPAN = 1 << 40


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024
    pool: int = 256


@dataclass(slots=True)
class Piece:
    """A run of a document's ids; those from ``loss_from`` on (within the piece) bear loss."""

    doc_id: int | None
    start: int
    ids: bytes
    loss_from: int
    doc_tokens: int

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return max(0, self.tokens - self.loss_from)

    def cut(self, at: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc_id, self.start, self.ids[: 4 * at], self.loss_from, self.doc_tokens)
        return head, Piece(self.doc_id, self.start + at, self.ids[4 * at :], max(0, self.loss_from - at), self.doc_tokens)

    def room_for(self, tokens: int, loss: int) -> int:
        """The most leading ids that keep within both rooms."""
        return min(self.tokens, tokens, self.loss_from + loss)


class Pool:
    """Waiting pieces and their demand vectors (a share of each limit)."""

    def __init__(self, limits: Limits):
        self.limits, self.pieces = limits, []
        self.demand = np.empty((0, 3))
        self.scale = np.array([limits.tokens, limits.segments, limits.loss], float)

    def vector(self, piece: Piece) -> np.ndarray:
        return np.array([piece.tokens, 1, piece.loss], float) / self.scale

    def add(self, pieces: list[Piece]) -> None:
        if not pieces:
            return
        self.pieces += pieces
        self.demand = np.vstack([self.demand, *(self.vector(p) for p in pieces)])

    def take(self, at: int) -> Piece:
        """Remove the piece at ``at``; the last one moves into its place."""
        piece, last = self.pieces[at], self.pieces.pop()
        if at < len(self.pieces):
            self.pieces[at], self.demand[at] = last, self.demand[-1]
        self.demand = self.demand[:-1]
        return piece

    def sequence(self) -> list[Piece]:
        """The next sequence, taken out of the pool."""
        chosen, room = [], np.ones(3)
        tokens, loss = self.limits.tokens, self.limits.loss
        while self.pieces and tokens and len(chosen) < self.limits.segments:
            fits = (self.demand <= room + 1e-9).all(axis=1)
            score = np.where(fits, self.demand @ room, -1.0)
            best = int(score.argmax())
            if fits[best]:
                piece = self.take(best)
            else:
                # nothing fits whole: cut the one of which most fits
                most = [p.room_for(tokens, loss) for p in self.pieces]
                best = int(np.argmax(most))
                if not most[best]:
                    break
                piece, rest = self.take(best).cut(most[best])
                self.add([rest])
            chosen.append(piece)
            tokens, loss = tokens - piece.tokens, loss - piece.loss
            room = np.array([tokens, self.limits.segments - len(chosen), loss]) / self.scale
        return chosen


def powers_of_two(pieces: list[Piece], full: int) -> list[list[Piece]]:
    """A short sequence as sequences whose lengths are powers of two, which need no padding."""
    left = sum(p.tokens for p in pieces)
    if left == full:
        return [pieces]
    out, waiting = [], list(reversed(pieces))
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        part: list[Piece] = []
        while want:
            piece = waiting.pop()
            if piece.tokens > want:
                piece, rest = piece.cut(want)
                waiting.append(rest)
            part.append(piece)
            want -= piece.tokens
        out.append(part)
    return out


def sequences(rows, encode, limits: Limits, end_id: int):
    """Pack ``(doc_id, text, loss_from)`` rows; yields each finished sequence as a list of pieces."""
    pool, end = Pool(limits), end_id.to_bytes(4, "little")
    for doc_id, text, loss_from in rows:
        ids = encode(text) + end
        rest, waiting = Piece(doc_id, 0, ids, max(0, loss_from or 0), len(ids) // 4), []
        while rest.tokens:
            head, rest = rest.cut(rest.room_for(limits.tokens, limits.loss))
            if head.tokens == limits.tokens:
                yield [head]
            else:
                waiting.append(head)
        pool.add(waiting)
        while len(pool.pieces) >= limits.pool:
            yield from powers_of_two(pool.sequence(), limits.tokens)
    while pool.pieces:
        yield from powers_of_two(pool.sequence(), limits.tokens)


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 0, loss_from: str | None = None) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids, loss_tokens, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit integers. ``loss_from`` names a column with
    the index of a document's first loss-bearing id (without it, or null: 0, all bear loss).
    A null text is empty, so its document is its end id alone. Repeated rows and doc ids are
    packed each for itself; a null doc id stays null. An empty table gives no rows. Other
    columns of ``docs`` are not read. Documents longer than a sequence are cut; so is what
    fills a last gap. A sequence that cannot be filled is split into lengths that are powers
    of two. Sequence ids do not change when a lost task runs again on the same rows.
    """
    begin = F.col(loss_from).cast("long") if loss_from else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), begin.alias("loss_from"))

    def task(batches):
        read = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        number, out = TaskContext.get().partitionId() * TASK_SPAN, []
        for pieces in sequences(read, encoder(tokenizer).encode, limits, end_id):
            offset = 0
            for p in pieces:
                out.append((p.doc_id, p.start, p.tokens, p.ids, p.loss, p.doc_tokens, number, offset))
                offset += p.tokens
            number += 1
            if len(out) >= 4000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return rows.mapInArrow(task, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
