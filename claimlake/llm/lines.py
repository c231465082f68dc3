"""Fuzzy line dedup by MinHash over character shingles.

Lines are cut, united and put back by DataFrame operations; signatures, the groups of bands and the exact comparison are numpy inside tasks,
because hashing every shingle as a row of its own, and later every band of a line, took several times the CPU time allowed (figures in the README).

Equal lines are one line (its 64-bit hash). A line's shingles are its runs of SHINGLE characters (code points; a shorter
line is one shingle), compared by 64-bit hashes. Of a long line's distinct shingles those count whose hash is 0 modulo 4^rung, so that about 256 to 1,024
do (all, should none be 0); a line near the border of two rungs signs for both, so similar lines share a rung. The signature has HASHES
least hashes under as many hash functions, the first of them in BANDS bands of ROWS. Bands are dealt as packed arrays with a sketch of each line, and
sketches meet in the task that has the whole group: the group's least line meets all others, then the least of those that it isn't like, and so on;
whoever is like it makes a pair. Linked lines are united (`components`). Then, in groups that still hold several components, the lines outside of
the greatest one meet all others, by sketch and by parities of all their shingles, in the task as well; where that
takes more than MET comparisons, the group is first split by least hashes that no band and no other split has, SPLITS pairs of them, up to DEPTH times.
Pairs that are left are compared exactly, on all shingles. At Jaccard similarity 0.75 a pair shares a band with chance 0.9997 (0.9992 where 256 shingles count), and each split keeps
it together with chance 0.9994 (0.9992).
A line is found by an edit of one character from 39 characters on, and of a word of six letters from 74 on.

One line of a component stays: the first by doc_id (null first), text hash and number. Lines of white space only stay as they
are. Null and empty texts stay as they are; rows that share doc_id and text lose the same lines; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batch_of, counted, mixed, settled, small, stored, table
from .components import components, labelled

SHINGLE, BANDS, ROWS = 5, 21, 4
#: Groups whose lines outside of their greatest component would meet more than MET others are split by SPLITS keys of NARROW least hashes of their own, up to DEPTH times.
MET, SPLITS, NARROW, DEPTH = 1 << 26, 9, 2, 2
HASHES, SKETCH = BANDS * ROWS + DEPTH * SPLITS * NARROW, 4
#: Longs with the least hashes of a line, eight in each.
LEASTS = [f"l{k}" for k in range(HASHES // 8)]
#: Longs with the parities of a line, 64 in each.
PARITIES = [f"p{k}" for k in range(16)]
LEAST = (75, 100)
#: Shingles of a line that are counted, about, at least, where a rung leaves some out.
COUNTED = 256
#: Lines up to which the ids of candidates are sent to all executors; more meet the texts by a shuffle.
BROADCAST_LINES = 300_000
#: And those up to which ids alone are.
BROADCAST_IDS = 1_000_000
#: Bands whose rows are dealt at a time, which bounds the disk that they take before most of them, with one line each, are left out.
PORTION = 7
#: Lines whose bands a task packs at a time, bytes of a packed row, and of those that one task gets, about.
PACKED, ROW, PART = 1 << 14, 16 + 8 * SKETCH, 6_000_000
#: Lines of a group that meet all others of it before any is united; comparisons made at a time in a task, and those up to which lines alone in a group look for any that is like them.
PIVOTS, AT_ONCE, LOOKED = 4096, 1 << 15, 1 << 24
#: Lines up to which groups choose their pivots side by side, and comparisons made at a time in a larger one.
TOGETHER, BLOCK = 48, 1 << 14
#: Characters hashed at a time in a task, and those of pairs whose sets are held at a time.
RUN, HELD = 1 << 16, 1_000_000
_rng = np.random.default_rng(3)
_POWERS = _rng.integers(0, 1 << 63, SHINGLE + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, no, line and id of each line that isn't white space only."""
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return own.where(F.col("line").rlike("\\S")).withColumn("id", F.xxhash64("line"))


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all shingles of all lines in turn, repeats included, and how many each line has."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    short, lengths = sizes < SHINGLE, np.maximum(sizes, SHINGLE)
    padded = "".join([t + "\0" * (SHINGLE - len(t)) for t in lines] if short.any() else lines)
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total = np.zeros(max(0, len(points) - SHINGLE + 1), np.uint64)
    part = np.empty_like(total)
    for k in range(SHINGLE):
        total += np.multiply(points[k:k + len(total)], _POWERS[k], out=part)
    inside = np.ones(len(total), bool)
    inside[(np.cumsum(lengths)[:-1, None] - np.arange(1, SHINGLE)).ravel()] = False
    hashes, counts = total[inside], lengths - SHINGLE + 1
    if short.any():
        # What is padded differs from a line that ends in zero characters.
        hashes += np.repeat(np.where(short, sizes + 1, 0), counts).astype(np.uint64) * _POWERS[-1]
    return mixed(hashes), counts


def _runs(lines: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Runs of lines that have so many characters together at most, or one longer line."""
    start = held = 0
    for i, t in enumerate(lines):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if lines:
        yield start, len(lines)


def _sets(lines: dict[int, str]) -> dict[int, np.ndarray]:
    """The sorted distinct shingle hashes of lines by id."""
    ids, texts, out = list(lines), list(lines.values()), {}
    for start, end in _runs(texts, RUN):
        hashes, counts = shingle_hashes(texts[start:end])
        out.update(zip(ids[start:end], map(_sorted, np.split(hashes, np.cumsum(counts)[:-1]))))
    return out


def _sorted(hashes: np.ndarray) -> np.ndarray:
    """The distinct ones; for so few this takes less than np.unique."""
    own = np.sort(hashes)
    return own[np.append(True, own[1:] != own[:-1])]


def _distinct(hashes: np.ndarray, counts: np.ndarray, border: float) -> np.ndarray:
    """How many distinct shingles each line has; of a line whose rung is 0 in any case, how many in all."""
    out, ends = counts.copy(), np.cumsum(counts)
    for k in np.flatnonzero(_rungs(counts * border)).tolist():
        out[k] = len(_sorted(hashes[ends[k] - counts[k]:ends[k]]))
    return out


def _rungs(counts: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.floor(np.log(counts / COUNTED) / np.log(4))).astype(np.int64)


def _least_hashes(hashes: np.ndarray, counts: np.ndarray, rungs: np.ndarray) -> np.ndarray:
    """The signature of each line on its rung: 8 bits of the least hash under each function."""
    x, many = (hashes >> np.uint64(32)).astype(np.uint32), counts.copy()
    if rungs.any():
        counted, ends = np.ones(len(x), bool), np.cumsum(counts)
        for k in np.flatnonzero(rungs).tolist():
            own = slice(ends[k] - counts[k], ends[k])
            some = hashes[own] & np.uint64((1 << 2 * int(rungs[k])) - 1) == 0
            if some.any():
                counted[own], many[k] = some, np.count_nonzero(some)
        x = x[counted]
    starts, out, part = np.cumsum(many) - many, np.empty((HASHES, len(counts)), np.uint32), np.empty_like(x)
    if len(counts):
        for c in range(HASHES):
            # In place: a new array for each function would take most of the time.
            np.minimum.reduceat(np.multiply(x, _A[c], out=part), starts, out=out[c])
    return np.ascontiguousarray((out * np.uint32(0x9E3779B1) >> np.uint32(24)).T.astype(np.uint8))


def _least_of(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The least hashes of each row, 8 bits each."""
    return np.column_stack([batch.column(c).to_numpy() for c in LEASTS]).view(np.uint8)


def _sketches(rows: np.ndarray) -> np.ndarray:
    """Two bits of each least hash, 32 of them in a word."""
    fours = (rows & 3).reshape(len(rows), -1, 4)
    out = np.zeros((len(rows), SKETCH * 8), np.uint8)
    out[:, :HASHES // 4] = fours[..., 0] | fours[..., 1] << 2 | fours[..., 2] << 4 | fours[..., 3] << 6
    return out.view(np.uint64)


def signatures(lines: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """id, rung, how many times it comes, and least hashes l0, l1, ... of each line."""
    border = 1.001 * least[1] / least[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, times = np.unique(batch.column("id").to_numpy(), return_index=True, return_counts=True)
            texts = batch.column("line").take(pa.array(first)).to_pylist()
            for start, end in _runs(texts, RUN):
                hashes, counts = shingle_hashes(texts[start:end])
                distinct = _distinct(hashes, counts, border)
                low, high = _rungs(distinct), _rungs(distinct * border)
                two = low != high
                rows = np.concatenate([_least_hashes(hashes, counts, low), _least_hashes(hashes[np.repeat(two, counts)], counts[two], high[two])]).view(np.int64)
                twice = lambda x: np.concatenate([x[start:end], x[start:end][two]])  # noqa: B023, E731
                yield batch_of(id=twice(ids), rung=np.concatenate([low, high[two]]).astype(np.int32), times=twice(times), **{c: np.ascontiguousarray(rows[:, k]) for k, c in enumerate(LEASTS)})

    signed = lines.select("id", "line").mapInArrow(run, f"id long, rung int, times long, {', '.join(f'{c} long' for c in LEASTS)}")
    # Whole numbers only, as rows with others are grouped by sorting them.
    return signed.groupBy("id", "rung").agg(F.sum("times").alias("times"), *(F.first(c).alias(c) for c in LEASTS))


def _keys(rows: np.ndarray, at: int, first: int, many: int, own: np.ndarray) -> np.ndarray:
    """A line of keys for each of so many runs of least hashes, from run `first` of those on that begin at `at`, within what is the rows' own."""
    width = ROWS if at == 0 else NARROW
    runs = rows[:, at + first * width:at + (first + many) * width].copy().view(f"<u{width}").T
    return _key(runs, np.arange(first, first + many)[:, None], own)


def _key(run: np.ndarray, number: np.ndarray, own: np.ndarray) -> np.ndarray:
    return mixed(mixed(run.astype(np.uint64) | number.astype(np.uint64) << np.uint64(32)) ^ own)


def _keyed(rows: DataFrame, at: int, many: int, own: str) -> DataFrame:
    """band, id and rung: a row for each of so many runs of least hashes that begin at `at`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(_least_of(batch), at, 0, many, batch.column(own).to_numpy().astype(np.uint64))
            yield batch_of(band=keys.ravel().view(np.int64), **{c: np.tile(batch.column(c).to_numpy(), many) for c in ("id", "rung")})

    return rows.mapInArrow(run, "band long, id long, rung int")


def bands(signed: DataFrame) -> DataFrame:
    """band, id and rung: a key for each band, as `_grouped` has them."""
    return _keyed(signed, 0, BANDS, "rung")


def _packed(signed: DataFrame, first: int, many: int, parts: int) -> DataFrame:
    """part and rows: the key, id and sketch of each line in so many bands from the first on, as arrays; equal keys have one part. A sketch's last 16 bits are the rung."""
    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(batches)
        least, rungs = _least_of(own), own.column("rung").to_numpy().astype(np.uint64)
        sketches, keys = _sketches(least), _keys(least, 0, first, many, rungs).ravel()
        sketches[:, -1] |= rungs << np.uint64(48)
        part = (keys % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
        order, counts = np.argsort(part, kind="stable"), np.bincount(part, minlength=parts)
        line, rows = order % len(rungs), np.empty((len(keys), ROW // 8), np.uint64)
        rows[:, 0], rows[:, 1], rows[:, 2:] = keys[order], own.column("id").to_numpy().view(np.uint64)[line], sketches[line]
        own_parts = np.flatnonzero(counts).astype(np.int32)
        ends = (np.concatenate([[0], np.cumsum(counts[own_parts])]) * ROW).astype(np.int32)
        return batch_of(part=own_parts, rows=pa.Array.from_buffers(pa.binary(), len(own_parts), [None, pa.py_buffer(ends), pa.py_buffer(rows)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield packed(held)
                held = []
        if sum(b.num_rows for b in held):
            yield packed(held)

    return signed.mapInArrow(run, "part int, rows binary").repartitionById(parts, "part")


def _most_different(least: tuple[int, int]) -> float:
    """By how many least hashes sketches may differ: five standard deviations more than those of a similarity of least do."""
    p = 0.75 * (1 - least[0] / least[1])
    return HASHES * p + 5 * (HASHES * p * (1 - p)) ** 0.5


def _differing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many least hashes sketches differ."""
    counts = _lanes(one ^ two)
    return sum(counts[:, k] for k in range(SKETCH))


def _lanes(x: np.ndarray) -> np.ndarray:
    """In each word, how many of its pairs of bits aren't 0; x is overwritten."""
    x |= x >> np.uint64(1)
    x &= np.uint64(0x5555555555555555)
    return np.bitwise_count(x)


def _begins(groups: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])[:len(groups)])


def _met(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows that meet so many others each: the row, and the number of the other, some at a time."""
    ends = np.cumsum(counts)
    for start in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        at = np.arange(start, min(start + AT_ONCE, int(ends[-1])))
        row = np.searchsorted(ends, at, "right")
        yield row, at - (ends - counts)[row]


def _pivots_of(sketches: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The pivots of one large group, and the rows that not all could be compared with."""
    pivots, rest, words, chosen = np.arange(len(sketches)), np.arange(len(sketches)), np.ascontiguousarray(sketches.T), 0
    while len(rest) > 1 and chosen < PIVOTS:
        many = max(1, min(len(rest), BLOCK // len(rest)))
        near = _lanes(words[:, :many, None] ^ words[:, None, :]).sum(axis=0, dtype=np.uint8) <= most
        taken = np.zeros(len(rest), bool)
        if np.count_nonzero(near) == many:
            taken[:many], chosen = True, chosen + many
        else:
            for k in range(many):
                if not taken[k]:
                    own = near[k] & ~taken
                    pivots[rest[own]], taken[own], chosen = rest[k], True, chosen + 1
        rest, words = rest[~taken], words[:, ~taken]
    return pivots, rest if len(rest) > 1 else rest[:0]


def _pivots(groups: np.ndarray, sketches: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in groups: each one's pivot, the first row of its group that no earlier pivot is like and that it is like, and whether the row is needed further.

    Needed is who is like any other row of its group by sketch, and whom not all could be compared with.
    """
    pivots, starts = np.arange(len(groups)), _begins(groups)
    sizes = np.diff(np.append(starts, len(groups)))
    unmet = np.zeros(len(groups), bool)
    for k in np.flatnonzero(sizes > TOGETHER).tolist():
        own = slice(starts[k], starts[k] + sizes[k])
        found, left = _pivots_of(sketches[own], most)
        pivots[own] = starts[k] + found
        unmet[own] = len(left) > 0
    live = np.flatnonzero(np.repeat(sizes <= TOGETHER, sizes))
    words = sketches[live]
    while len(live):
        starts = _begins(groups[live])
        sizes = np.diff(np.append(starts, len(live)))
        rest = np.repeat(sizes > 1, sizes)
        rest[starts] = False
        pivot = np.repeat(starts, sizes)[rest]
        first, live, words = live[pivot], live[rest], (words[pivot], words[rest])
        near = _differing(*words) <= most
        pivots[live[near]], live, words = first[near], live[~near], words[1][~near]
    needed = pivots != np.arange(len(groups))
    needed[pivots[needed]] = True
    # A pivot that is like nobody left may be like those that went to earlier pivots.
    size = groups[-1] + 1 if len(groups) else 0
    alone, like = np.flatnonzero(~needed & ~unmet), np.flatnonzero(needed & ~unmet)
    of_group = np.bincount(groups[like], minlength=size)
    unmet |= (np.bincount(groups[alone], minlength=size) * of_group > LOOKED)[groups] & (of_group > 0)[groups]
    alone = alone[~unmet[alone]]
    begin = np.searchsorted(groups[like], groups[alone])
    for row, k in _met(of_group[groups[alone]]):
        needed[alone[row[_differing(sketches[alone[row]], sketches[like[begin[row] + k]]) <= most]]] = True
    return pivots, needed | unmet


def _grouped(packed: DataFrame, least: tuple[int, int]) -> DataFrame:
    """band, id, rung and pivot (an id) of the lines that are like another one of their band by sketch."""
    most = _most_different(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = b"".join(x for batch in batches for x in batch.column("rows").to_pylist())
        rows = np.frombuffer(rows, np.uint64).reshape(-1, ROW // 8)
        keys = np.ascontiguousarray(rows[:, 0])
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        rows = rows[order[np.append(same, False)[:len(order)] | np.append(False, same)[:len(order)]]]
        rows = rows[np.lexsort((rows[:, 1].view(np.int64), rows[:, 0]))]
        groups = np.zeros(len(rows), np.int64)
        groups[_begins(rows[:, 0])[1:]] = 1
        ids, sketches = rows[:, 1].view(np.int64), np.ascontiguousarray(rows[:, 2:])
        pivots, needed = _pivots(np.cumsum(groups), sketches, most)
        if needed.any():
            yield batch_of(band=rows[needed, 0].view(np.int64), id=ids[needed], rung=(rows[needed, -1] >> np.uint64(48)).astype(np.int32), pivot=ids[pivots[needed]])

    return packed.mapInArrow(run, "band long, id long, rung int, pivot long")


def _narrower(rows: DataFrame, signed: DataFrame, depth: int) -> DataFrame:
    """Rows (band, id, rung) under the keys of their band and of the least hashes that are this depth's own."""
    own = rows.select("id", "rung", F.col("band").alias("own")).join(signed.select("id", "rung", *LEASTS), ["id", "rung"])
    return _keyed(own, BANDS * ROWS + depth * SPLITS * NARROW, SPLITS, "own")


def parities(texts: DataFrame) -> DataFrame:
    """id, n (distinct shingles) and p0, p1, ... of each line: a bit is set where an odd number of its distinct shingles fall."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines, many = batch.column("id").to_numpy(), batch.column("line").to_pylist(), 64 * len(PARITIES)
            for start, end in _runs(lines, RUN):
                sets = list(_sets(dict(zip(ids[start:end].tolist(), lines[start:end]))).values())
                odd = np.array([np.bincount((s & np.uint64(many - 1)).astype(np.int64), minlength=many) & 1 for s in sets], np.uint8)
                words = np.packbits(odd, axis=1, bitorder="little").view("<i8")
                yield batch_of(id=ids[start:end], n=np.array(list(map(len, sets)), np.int64), **{c: np.ascontiguousarray(words[:, k]) for k, c in enumerate(PARITIES)})

    return texts.select("id", "line").mapInArrow(run, f"id long, n long, {', '.join(f'{c} long' for c in PARITIES)}")


def _possible(pairs: DataFrame, odd: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b) those that parities and sizes allow.

    Two sets differ in as many shingles as they have differing parities, at least; at similarity s in (1 - s) / (1 + s) of both their sizes, at most.
    """
    one, two = (odd.select("id", "n", *PARITIES).withColumnsRenamed({"id": c} | {k: f"{c}_{k}" for k in ("n", *PARITIES)}) for c in "ab")
    differ = " + ".join(f"bit_count(a_{k} ^ b_{k})" for k in PARITIES)
    met = pairs.join(one, "a").join(two, "b")
    return met.where(f"greatest({differ}, abs(a_n - b_n)) * {least[1] + least[0]} <= (a_n + b_n) * {least[1] - least[0]}").select("a", "b")


def _linked(pairs: DataFrame, texts: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of lines whose full shingle sets reach intersection / union >= least."""
    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        if least[1] * min(len(x), len(y)) < least[0] * max(len(x), len(y)):
            return False
        common = len(np.intersect1d(x, y, assume_unique=True))
        return least[1] * common >= least[0] * (len(x) + len(y) - common)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "one", "two"))))
            for start, end in _runs([one + two for *_, one, two in pairs], HELD):
                part = pairs[start:end]
                sets = _sets({i: t for a, b, one, two in part for i, t in ((a, one), (b, two))})
                keep = pa.array([similar(sets[a], sets[b]) for a, b, *_ in part], pa.bool_())
                yield batch.slice(start, end - start).select(["a", "b"]).filter(keep)

    one, two = (texts.toDF(*own) for own in (("a", "one"), ("b", "two")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(confirm, "a long, b long")


def _pair(one: str, two: str) -> list[Column]:
    return [F.greatest(one, two).alias("a"), F.least(one, two).alias("b")]


def _mixed(rows: DataFrame, features: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the groups with several components, with comp, the group's greatest component, how many comparisons the lines outside of it make, and the features."""
    rows = stored(labelled(rows.select("band", "id", "rung"), found))
    sizes = rows.groupBy("band", "comp").agg(F.count("*").alias("n"))
    live = (sizes.groupBy("band").agg(F.max("n").alias("most"), F.max_by("comp", "n").alias("main"), F.sum("n").alias("all"), F.count("*").alias("comps"))
            .where("comps > 1").select("band", "main", F.expr("(all - most) * all").alias("met")))
    return rows.join(live, "band").join(features, ["id", "rung"])


def _across(ready: DataFrame, least: tuple[int, int], once: bool) -> DataFrame:
    """Pairs (a, b) of a line outside of its group's greatest component and one of another component, that sketches, sizes and parities allow.

    once: the groups are all those of the bands that have lines alike, and a pair comes from the first that it shares only.

    They meet in the task that has their group: pairs that don't pass, which grow with the square of a group's size, are never made as rows.
    """
    most, (num, den) = _most_different(least), least

    def met(own: pa.Table, fresh: int) -> pa.RecordBatch:
        """Of rows sorted by band, those outside of the greatest component first: the pairs with one of the rows from fresh on."""
        band, ids, comp, main, n = (own.column(c).to_numpy() for c in ("band", "id", "comp", "main", "n"))
        hashes = _least_of(own)
        sketches, odd = _sketches(hashes), np.column_stack([own.column(c).to_numpy() for c in PARITIES]).view(np.uint64)
        begins = _begins(band)
        ends = np.repeat(np.append(begins[1:], len(band)), np.diff(np.append(begins, len(band))))
        outside = np.flatnonzero(comp != main)
        after = np.maximum(outside + 1, fresh)
        pairs, rungs, runs = [], own.column("rung").to_numpy().astype(np.uint64), hashes[:, :BANDS * ROWS].copy().view(f"<u{ROWS}")

        def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            at = np.argmax(runs[x] == runs[y], axis=1)
            return _key(runs[x, at], at, rungs[x]) == band[x].view(np.uint64)

        for row, k in _met(np.maximum(0, ends[outside] - after)):
            x, y = outside[row], after[row] + k
            for passes in (lambda: comp[x] != comp[y], lambda: _differing(sketches[x], sketches[y]) <= most,  # noqa: B023
                           lambda: np.maximum(np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64), abs(n[x] - n[y])) * (den + num) <= (n[x] + n[y]) * (den - num)):  # noqa: B023
                keep = passes()
                x, y = x[keep], y[keep]
            if once:
                keep = first_shared(x, y)
                x, y = x[keep], y[keep]
            pairs.append(np.stack([np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y])], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        return batch_of(a=np.ascontiguousarray(pairs[:, 0]), b=np.ascontiguousarray(pairs[:, 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = None, 0
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows - fresh >= PACKED:
                yield met(held, fresh)
                # Of the last group, which may go on, the rows outside of the greatest component stay.
                last = held.column("band")[-1].as_py()
                held = held.filter(pc.and_(pc.equal(held.column("band"), last), pc.not_equal(held.column("comp"), held.column("main")))).combine_chunks()
                fresh = held.num_rows
        if held is not None and held.num_rows > fresh:
            yield met(held, fresh)

    ready = ready.select("band", "id", "rung", "comp", "main", "n", *LEASTS, *PARITIES)
    return ready.repartition("band").sortWithinPartitions("band", F.col("comp") == F.col("main")).mapInArrow(run, "a long, b long")


def line_components(lines: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """id and component of the lines that are similar to another one or come several times."""
    signed, n = counted(signatures(lines, least))
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * PORTION * ROW // PART))
    groups = [stored(_grouped(_packed(signed, k, min(PORTION, BANDS - k), parts), least)) for k in range(0, BANDS, PORTION)]
    rows = reduce(DataFrame.union, groups)
    ids = small(stored(rows.select("id").distinct()), BROADCAST_IDS)
    texts = stored(lines.select("id", "line").join(ids, "id", "left_semi").dropDuplicates(["id"]))
    odd = stored(parities(texts))
    features = stored(signed.drop("times").join(small(odd, BROADCAST_LINES), "id"))
    exactly = lambda pairs: settled(lambda: _linked(stored(_possible(stored(pairs.distinct()), small(odd, BROADCAST_LINES), least)), texts, least))
    links = exactly(rows.where("id != pivot").select(*_pair("id", "pivot")))
    found, tables = settled(lambda: components(links, hashed=True)), groups
    for depth in range(DEPTH + 1):
        known = small(found, BROADCAST_IDS)
        # Some bands at a time, which bounds what their shuffles take.
        ready = reduce(DataFrame.union, [settled(lambda: _mixed(part, features, known)) for part in tables])  # noqa: B023
        large = F.col("met") > (MET if depth < DEPTH else 1 << 62)
        more = ready.where(large).select("band", "id", "rung")
        split = more.limit(1).count() > 0
        pairs = stored(_across(ready.where(~large), least, once=not depth and not split))
        if not split and not pairs.limit(1).count():
            break
        if split:
            narrow = stored(_narrower(more, features, min(depth, DEPTH - 1)))
            pivots = narrow.groupBy("band").agg(F.min("id").alias("pivot"))
            pairs, tables = pairs.union(narrow.join(pivots, "band").where("id != pivot").select(*_pair("id", "pivot"))), [narrow]
        links = exactly(pairs)
        found = settled(lambda: components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links), hashed=True))  # noqa: B023
        if not split:
            break
    again = signed.where("times > 1").select("id").distinct().join(found, "id", "left_anti")
    return found.select("id", "component").union(again.select("id", F.col("id").alias("component")))


def _gone(lines: DataFrame, found: DataFrame) -> DataFrame:
    """gone_doc, gone_hash and gone: the numbers of the lines that go, by doc_id and text hash."""
    place = F.struct("doc_id", "text_hash", "no").alias("place")
    own = stored(lines.select("id", place).join(small(found, BROADCAST_IDS), "id").select("component", "place"))
    keepers = own.groupBy("component").agg(F.min("place").alias("keeper"))
    gone = own.join(keepers, "component").where(~F.col("place").eqNullSafe(F.col("keeper")))
    return gone.groupBy(F.col("place.doc_id").alias("gone_doc"), F.col("place.text_hash").alias("gone_hash")).agg(F.collect_set("place.no").alias("gone"))


def dedup_lines(docs: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """docs with the lines that stay in text, and n_lines and n_kept (lines that aren't white space only)."""
    lines = lines_of(docs)
    found = settled(lambda: line_components(lines, least))
    gone = settled(lambda: _gone(lines, found))
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_kept")]
    # Texts are cut before the join: behind it, text would be cut anew for every line that is taken from it.
    keyed = docs.select(*kept, F.xxhash64("text").alias("own_hash"), F.split("text", "\n").alias("all_lines"))
    out = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["gone_doc"]) & (keyed["own_hash"] == gone["gone_hash"]), "left")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), F.col("gone")), lambda i: F.col("all_lines")[i])
    n_lines = F.when(F.col("all_lines").isNull(), 0).otherwise(F.size(F.filter("all_lines", lambda line: line.rlike("\\S"))))
    return out.select(*kept, F.array_join(F.when(F.col("gone").isNull(), F.col("all_lines")).otherwise(stay), "\n").alias("text"),
                      n_lines.cast("long").alias("n_lines"), (n_lines - F.coalesce(F.size("gone"), F.lit(0))).cast("long").alias("n_kept"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text (the lines that stay), n_lines and n_kept of every document."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
