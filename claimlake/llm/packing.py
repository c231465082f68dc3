"""Sum-of-squares packing of documents into windows of 4,096 tokens.

Each task packs the documents of its own split in one pass. Full windows of a long document leave at once. The rest of a
document goes, whole, to the fill level h (0: a new window) for which the sum over all levels of the squared number of open
windows becomes least; an array counts the open windows of each level. What is still open at the end is cut: it fills
whole windows one after another, and the last rest becomes windows whose sizes are powers of two, so nothing is padded.

Null texts count as empty (one end id), rows with null or repeated doc_ids are packed like any other, other columns are
ignored, an empty table gives no rows. A task holds the ids of its open windows only, `most_open` windows at most; when
there are more it cuts them as at the end.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import tokens
from .common import table

WINDOW = 4096
#: Open windows of a task, some 64 MB of ids.
MOST_OPEN = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
Piece = tuple[object, int, int, np.ndarray]  # document, ids before it, the document's ids, the piece's ids


class SumOfSquares:
    """Packs pieces; rows() hands over those whose window is done."""

    def __init__(self, window: int, first_sequence: int, most_open: int = MOST_OPEN):
        self.window, self.sequence, self.most_open = window, first_sequence, most_open
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.counts = np.zeros(window + 1, np.int64)
        self.n_open = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def level_for(self, size: int) -> int:
        """The level whose choice leaves the least sum of squared counts; of equals the fullest."""
        cost = 2 * self.counts[size:] + 1
        cost[-1] = 0  # a full window is no longer open
        left = self.counts[:len(cost)]
        cost[1:] += 1 - 2 * left[1:]
        cost[1:][left[1:] == 0] = np.iinfo(np.int64).max
        return int(len(cost) - 1 - cost[::-1].argmin())

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        total = len(ids)
        for start in range(0, total - self.window + 1, self.window):
            self._close([(doc_id, start, total, ids[start:start + self.window])])
        if not (rest := total % self.window):
            return
        level = self.level_for(rest)
        pieces = self.open[level].pop() if level else []
        pieces.append((doc_id, total - rest, total, ids[total - rest:]))
        self.counts[level] -= level > 0
        self.n_open -= level > 0
        if (level := level + rest) == self.window:
            self._close(pieces)
            return
        self.open[level].append(pieces)
        self.counts[level] += 1
        self.n_open += 1
        if self.n_open > self.most_open:
            self.finish()

    def finish(self) -> None:
        """Cuts what is open into full windows and, at last, windows of powers of two."""
        left = [p for windows in self.open for pieces in windows for p in pieces]
        rest = sum(len(p[3]) for p in left)
        self.open, self.n_open = [[] for _ in range(self.window)], 0
        self.counts[:] = 0
        while rest:
            room = self.window if rest >= self.window else 1 << rest.bit_length() - 1
            rest -= room
            pieces = []
            while room:
                doc_id, start, total, ids = left.pop()
                pieces.append((doc_id, start, total, ids[:room]))
                if len(ids) > room:
                    left.append((doc_id, start + room, total, ids[room:]))
                room -= len(pieces[-1][3])
            self._close(pieces)

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.done)) or [()] * 7
        self.done = []
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, most_open: int = MOST_OPEN) -> DataFrame:
    """One row for each piece of docs (doc_id, text). Numbers of sequences begin with the task's own."""
    vocabulary = vocabulary or tokens.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 40, most_open)
        for batch in batches:
            for start, end in tokens.portions(batch.column("text")):
                texts = encoder.encode(batch.column("text")[start:end].to_pylist())
                for doc_id, ids in zip(batch.column("doc_id")[start:end].to_pylist(), texts):
                    packer.add(doc_id, np.frombuffer(ids, encoder.dtype))
            yield packer.rows()
        packer.finish()
        yield packer.rows()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
