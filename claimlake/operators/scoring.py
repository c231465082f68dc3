"""Scoring kernels: blocks of documents against a bounded batch of queries, inside tasks, with the best per query kept.

A batch of queries is known to every task as arrays: vectors as a matrix, terms as lists of (query, weight) per term number.
Its size is bounded by `MOST_QUERIES`, `BATCH_BYTES` and `MOST_TERMS`; more queries are several batches. A task turns an Arrow
batch of documents into a block of scores by one matrix product and a sparse sum, and hands on only the best of each
query, so no row per document and query ever leaves it. Scores by word are summed as whole numbers, as everywhere.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.5, 0.75  # fixed values: BM25
SCALE = 1e12
DIGITS = 9
MOST_QUERIES = 4096
BATCH_BYTES = 64_000_000
MOST_TERMS = 500_000
#: Scores that a task holds at once, and pairs of a posting and a query that asks for it.
BLOCK, PAIRS = 200_000, 500_000
#: Rows that the lists of a task may hold beyond four times what they keep, before they are cut.
SPARE = 100_000


@dataclass(frozen=True)
class Queries:
    """A batch of queries by number."""

    ids: list
    #: per size of vectors: the numbers of the queries that have one, their vectors as columns, and their lengths
    senses: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: term t is asked by queries[starts[t]:starts[t + 1]], as often as in times
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    queries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    avgdl: float = 1.0

    def __len__(self) -> int:
        return len(self.ids)

    def block_rows(self, most: int = BLOCK) -> int:
        return max(1, most // max(1, len(self)))


def lengths(vectors: np.ndarray) -> np.ndarray:
    """The lengths of the rows; 1 for a zero vector, so that it stays zero."""
    size = np.sqrt((vectors * vectors).sum(axis=1))
    return np.where(size == 0, 1.0, size)


def matrices(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per size the places and the matrix of the vectors of that size; absent vectors and those with missing numbers are left out."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts, found = np.cumsum(sizes) - sizes, {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        matrix = flat[starts[at][:, None] + np.arange(size)]
        whole = ~np.isnan(matrix).any(axis=1)
        found[size] = at[whole], matrix[whole]
    return found


def with_senses(ids: list, vectors: pa.Array) -> Queries:
    return Queries(ids, {size: (at, matrix.T.copy(), lengths(matrix)) for size, (at, matrix) in matrices(vectors).items()})


def cosines(asked: Queries, vectors: pa.Array, n: int) -> np.ndarray:
    """Rounded cosines, documents by queries; 0 where one is absent or of another size."""
    out = np.zeros((n, len(asked)))
    for size, (at, matrix) in matrices(vectors).items():
        if size in asked.senses:
            numbers, columns, own = asked.senses[size]
            out[np.ix_(at, numbers)] = np.round(matrix @ columns / (lengths(matrix)[:, None] * own), DIGITS) + 0.0
    return out


def part(tf: np.ndarray, dl: np.ndarray, avgdl: float, idf: np.ndarray) -> np.ndarray:
    tf, dl = tf.astype(np.float64), dl.astype(np.float64)
    return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def spread(asked: Queries, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each of the terms once per query that asks for it: places in `terms`, queries, times."""
    n = asked.starts[terms + 1] - asked.starts[terms]
    rows = np.repeat(np.arange(len(terms)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(asked.starts[terms], n)
    return rows, asked.queries[at], asked.times[at]


def portions(asked: Queries, terms: np.ndarray) -> Iterator[slice]:
    """All postings in turn, so many at once that they meet some `PAIRS` queries."""
    upto = np.cumsum(asked.starts[terms + 1] - asked.starts[terms])
    start = 0
    while start < len(terms):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        yield slice(start, end)
        start = end


def lexical(asked: Queries, docs: np.ndarray, terms: np.ndarray, tf: np.ndarray, dl: np.ndarray, n: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Rounded BM25, documents by queries, from postings: document, term, how often, the document's length; 0 for pairs not wanted."""
    sums = np.zeros((n, len(asked)), np.int64)
    for s in portions(asked, terms):
        whole = np.floor(part(tf[s], dl[s], asked.avgdl, asked.idf[terms[s]]) * SCALE + 0.5).astype(np.int64)
        rows, queries, times = spread(asked, terms[s])
        at = docs[s][rows]
        if wanted is not None:
            some = wanted[at, queries]
            rows, queries, times, at = rows[some], queries[some], times[some], at[some]
        np.add.at(sums, (at, queries), whole[rows] * times)
    step = round(SCALE / 10 ** DIGITS)
    return np.sign(sums) * ((np.abs(sums) + step // 2) // step) / 10.0 ** DIGITS


def bounds(asked: Queries, ranges: np.ndarray, terms: np.ndarray, max_tf: np.ndarray, min_dl: np.ndarray, n: int) -> np.ndarray:
    """Ranges by queries: no document of the range scores more. A term gives most where it is most frequent and the text shortest."""
    most = np.maximum(part(max_tf, min_dl, asked.avgdl, asked.idf[terms]), 0)
    sums = np.zeros((n, len(asked)))
    for s in portions(asked, terms):
        rows, queries, times = spread(asked, terms[s])
        np.add.at(sums, (ranges[s][rows], queries), most[s][rows] * times)
    return sums * (1 + 1e-9) + 10.0 ** -DIGITS  # never below a sum that was added up otherwise and rounded


class Best:
    """The first k per query by score, second score and order; blocks are compared with the k-th at once."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.rows, self.held = n, k, [], 0
        self.full = np.zeros(n, bool)
        self.least, self.second, self.last = np.zeros(n), np.zeros(n), None

    def add(self, first: np.ndarray, second: np.ndarray | None, order: np.ndarray, ids: np.ndarray, wanted: np.ndarray | None = None) -> None:
        """first, second: documents by queries; order, ids: of the documents; wanted: pairs that count, all if absent."""
        if not len(order):
            return
        if self.last is None:
            self.last = np.full(self.n, order[0], order.dtype)
        tied = order[:, None] < self.last
        if second is not None:
            tied = (second > self.second) | (second == self.second) & tied
        passes = ~self.full | (first > self.least) | (first == self.least) & tied
        docs, queries = np.nonzero(passes if wanted is None else passes & wanted)
        self.rows.append((queries, first[docs, queries], np.zeros(len(docs)) if second is None else second[docs, queries], order[docs], ids[docs]))
        self.held += len(docs)
        if self.held > 4 * self.k * self.n + SPARE:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.rows:
            return tuple(np.zeros(0, t) for t in (np.int64, float, float, object, object))
        queries, first, second, order, ids = (np.concatenate(x) for x in zip(*self.rows))
        place = np.unique(order, return_inverse=True)[1] if order.dtype == object else order
        at = np.lexsort((place, -second, -first, queries))
        heads = np.flatnonzero(np.diff(queries[at], prepend=-1))
        rank = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
        last = at[rank == self.k - 1]
        self.full[queries[last]] = True
        self.least[queries[last]], self.second[queries[last]], self.last[queries[last]] = first[last], second[last], order[last]
        at = at[rank < self.k]
        self.rows, self.held = [(queries[at], first[at], second[at], order[at], ids[at])], len(at)
        return self.rows[0]


def values(column: pa.Array) -> np.ndarray:
    """Numbers as numbers, all else as Python values."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def flattened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each element of a list column, and the elements; null lists are empty."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def by_range(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows cut anew where `range` changes, so that no range is in two; a batch has about `most` ranges."""
    kept: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
    for b in batches:
        if not b.num_rows:
            continue
        ranges = b["range"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(ranges)) + 1
        if kept and kept[-1]["range"][-1].as_py() != ranges[0]:
            yield whole()
            kept = []
        start = 0
        for cut in cuts[most - 1::most].tolist() + cuts[-1:].tolist():
            if cut > start:
                kept.append(b.slice(start, cut - start))
                yield whole()
                kept, start = [], cut
        kept.append(b.slice(start))
    if kept:
        yield whole()


def batches_of(queries: DataFrame, terms: int, dim: int, n: int) -> list[DataFrame]:
    """The queries in batches within the bounds, dealt by a hash of their ids."""
    many = max(1, -(-n // (MOST_QUERIES // 2)), -(-8 * dim * n // (BATCH_BYTES // 2)), -(-terms // (MOST_TERMS // 2)))
    if many == 1:
        return [queries]
    group = F.pmod(F.xxhash64("query_id"), F.lit(many))
    return [queries.filter(group == i) for i in range(many)]

