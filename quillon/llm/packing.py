"""Harmonic packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import bpe
from quillon.llm.common import map_texts

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def cut(n: int, capacity: int, slack: int = 32) -> list[int]:
    """Lengths of the pieces of a document of n tokens: whole sequences, then pieces that nearly fill a class's share.

    A length l belongs to class k = capacity // l, whose share is capacity // k. A rest wastes at most 1 in `slack` of
    its share, or it gives up a piece of exactly the next smaller share, and its own rest is looked at again. Rests
    below `slack` tokens are never cut: their classes are so narrow that they waste little.
    """
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        share = capacity // k
        if rest < slack or (share - rest) * slack <= share:
            out.append(rest)
            break
        piece = capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


@dataclass
class Packer:
    """The bins of one worker: an open one for each class, closed when it holds k pieces of class k.

    An open bin of class k waits for at most k - 1 pieces, so for any number of documents all open bins hold fewer than
    the sum of k - 1 over the classes that there are: 4,576 pieces, of a token to a sequence each, for 1024. What is left at the end of a
    worker's share is packed by first fit, longest first, over all classes.
    """

    capacity: int
    first_id: int
    bins: dict[int, list] = field(default_factory=dict)
    closed: int = 0

    def add(self, length: int, piece: tuple) -> list[tuple]:
        """The pieces that got their places by this one: none, or the whole bin that it closed."""
        k = self.capacity // length
        waiting = self.bins.setdefault(k, [])
        waiting.append((length, piece))
        return self._close(self.bins.pop(k)) if len(waiting) == k else []

    def _close(self, pieces: list) -> list[tuple]:
        sequence, at, out = self.first_id + self.closed, 0, []
        self.closed += 1
        for length, piece in pieces:
            out.append((sequence, at, length, piece))
            at += length
        return out

    def finish(self) -> list[tuple]:
        rest = sorted((x for b in self.bins.values() for x in b), key=lambda x: -x[0])
        self.bins, open_bins, free = {}, [], []
        for length, piece in rest:
            i = next((i for i, f in enumerate(free) if f >= length), len(free))
            if i == len(free):
                open_bins.append([])
                free.append(self.capacity)
            open_bins[i].append((length, piece))
            free[i] -= length
        return [x for b in open_bins for x in self._close(b)]


def _rows(placed: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(8)]
    for sequence, at, length, (doc, start, total, data) in placed:
        row = (doc, start, length, zlib.crc32(data), total, sequence, at, data if with_ids else None)
        for c, v in zip(cols, row, strict=True):
            c.append(v)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def pack(
    docs: DataFrame, capacity: int = 1024, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = True
) -> DataFrame:
    """Pack whole texts into sequences of at most `capacity` tokens; one row for each piece of a document.

    Every worker fills the bins of its own share of the rows, so nothing is shuffled and a lost task is simply run
    again with the same result. The share's number is in the upper bits of `sequence_id`.

    docs: doc_id and text are read; any other column is ignored. A null or empty text gives one piece, the end id
    alone. Rows with a null doc_id are packed with a null doc_id; repeated rows are packed each. An empty table gives
    no rows. `ids` has the piece's ids as little-endian unsigned 32-bit integers (null unless with_ids).
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = bpe.load(vocabulary)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), np.array([end_id], dtype="<u4")).astype("<u4")
                data, start = ids.tobytes(), 0
                for length in cut(len(ids), capacity):
                    placed += packer.add(length, (doc, start, len(ids), data[4 * start : 4 * (start + length)]))
                    start += length
                if len(placed) > 20_000:
                    yield _rows(placed, with_ids)
                    placed = []
            yield _rows(placed, with_ids)
        yield _rows(packer.finish(), with_ids)

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), task, SCHEMA)
