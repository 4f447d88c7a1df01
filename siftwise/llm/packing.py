"""Best-fit packing of token sequences with a bounded number of open bins.

Documents are tokenized once (Arrow batches, whole texts), closed by an end id and
cut into pieces of at most ``CAPACITY`` tokens; the table of pieces is kept in the
shared folder.  Pieces are dealt evenly to tasks of about ``TOKENS_PER_TASK`` tokens.
Within a task they come in the order of a hash and are placed online: the open bin
with the least room that still holds the piece takes it.  Open bins are keyed by
their room; a bitset of the rooms in use finds the best fit by a shift and a lowest
bit.  At most ``OPEN_BINS`` bins are open: when one more is needed, the fullest closes.

Pieces leave as soon as they are placed, so a task holds its open bins only.  The
pieces are read from the shared folder and sorted, so a task that is run again
gives the same sequences.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, saved, tidied
from .registry import query
from .textcodes import buffers, slices
from .tokens import public_path, word_encoder

CAPACITY = 2048
END_ID = 0
OPEN_BINS = 1024
TOKENS_PER_TASK = 8_000_000
CHUNK_BYTES = 512 << 10
VOCABULARY = "word_bpe_49k.json"


def _pieces(path: str | None, capacity: int, end: int):
    def run(batches):
        """(doc_id, text) -> doc_id, piece, start, length, ids_crc32"""
        import pyarrow as pa

        encoder = word_encoder(path or public_path(VOCABULARY))
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets, CHUNK_BYTES):
                ids, bounds = encoder.encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], end)
                raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
                total = np.diff(bounds)
                n = -(-total // capacity)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, total[doc] - start)
                at = bounds[:-1][doc] + start
                crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
    return tidied(run)


class Bins:
    """Open bins by room, with a bitset of the rooms in use."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.rooms, self.open, self.by_room, self.made = 0, 0, {}, 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fits = self.rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            if self.open >= self.most:
                self._take((self.rooms & -self.rooms).bit_length() - 1)   # the fullest closes
            number, room = self.made, self.capacity
            self.made += 1
        left = room - length
        if left:
            self.by_room.setdefault(left, []).append(number)
            self.rooms |= 1 << left
            self.open += 1
        return number, self.capacity - room

    def _take(self, room: int) -> int:
        stack = self.by_room[room]
        number = stack.pop()
        if not stack:
            del self.by_room[room]
            self.rooms &= ~(1 << room)
        self.open -= 1
        return number


def _pack(capacity: int, open_bins: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        bins, base = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return tidied(run)


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
           capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.  ``path``: a vocabulary
    file (default: the public one, found where the task runs).  Null texts are empty: the
    end id alone.  Every row of ``docs`` is a document, also with a repeated or null id."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_pieces(path, capacity, end),
                        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
         capacity: int = CAPACITY, end: int = END_ID, open_bins: int = OPEN_BINS,
         tokens_per_task: int = TOKENS_PER_TASK) -> DataFrame:
    """One row per piece with its place: (id_col, piece, start, length, ids_crc32, sequence_id, offset).

    An empty table gives no rows."""
    p = saved(pieces(docs, id_col, text, path, capacity, end))
    tokens = p.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, math.ceil(tokens / tokens_per_task))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = p.repartition(tasks).sortWithinPartitions(order, "doc_id", "piece", "ids_crc32", "start", "length")
    kind = p.schema["doc_id"].dataType.simpleString()
    out = dealt.mapInArrow(_pack(capacity, open_bins), f"doc_id {kind}, piece int, start long, length long, "
                           "ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)


@query("op10_packing")
def op10_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"))
