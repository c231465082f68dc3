"""Near-duplicate documents by chosen paths: a similarity join over minwise tokens.

A document's set is that of its five-word shingles. Documents of one set are one class (its 64-bit fingerprint). A class has
COORDINATES minwise tokens. In each of TREES independent trees a class stands at the root; every node chooses one or two
coordinates, and for each of them the class goes on to the child named by the node, the coordinate and its token there. Two
classes of similarity s follow the same branch with chance s. After DEPTH levels, nodes of up to LEAF classes are compared
exhaustively; in a larger one each class meets the node's pivot, chosen by hash. A pair whose two-bit sketches and parities allow
the threshold is confirmed on its full sets, from the texts; parities never rule out a pair that has it. Confirmed components are contracted: a node of one component has no
more to show, which keeps large groups of near copies from being compared all with all. In a large node that still
holds several components, the members outside of its greatest one first meet one of its members; then those that no link has
brought in meet all others if they are OUTSIDE at most; if they are more, the node branches DEPTH levels further, down to
MOST_DEPTH, where the rest is compared in that way. Comparing two sketches where they meet costs so little against a row of a
node further down that branching pays only from some thousands on.

At similarity 0.85 a tree follows a pair to depth 3 with chance 0.87 (at 0.8: 0.8), so six trees miss less than one pair in 10,000.

Words split at ASCII white space, A-Z become lower case. Null texts and texts without words have an empty set, are in no
group and kept. Equal or null doc_ids each have a row. An empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, batch_of, map_batches, mixed, settled, small, stored, table
from .components import components, labelled

SHINGLE, COORDINATES, LEAF = 5, 128, 32
TREES, DEPTH, MOST_DEPTH = 6, 3, 9
#: Members outside of a large node's greatest component that meet all others there; with more, the node branches on.
OUTSIDE = 4096
#: Longs with the parities of a set, 64 in each.
PARITIES = [f"p{k}" for k in range(8)]
#: What a class brings to a comparison.
SKETCH = ["s0", "s1", "s2", "s3", "size", *PARITIES]
#: Words whose hashes a worker keeps; beyond that it starts anew.
KNOWN_WORDS = 200_000
#: Classes up to which the list of those to confirm is sent to all executors; more meet the texts by a shuffle.
BROADCAST_CLASSES = 100_000
_CASE = str.maketrans(UPPER, LOWER)
_WORD = re.compile("[^\x20\x09-\x0D]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(6)
_A = (_rng.integers(0, 1 << 32, COORDINATES, np.uint32) | 1)[:, None]
_B = _rng.integers(0, 1 << 32, COORDINATES, np.uint32)[:, None]
_POWERS = _rng.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_words: dict[str, int] = {}


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; with fewer words the whole sequence is one."""
    words = _WORD.findall((text or "").translate(_CASE))
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(" ".join(words), 1)], np.uint64)
    if len(_words) > KNOWN_WORDS:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    own = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = own[:n] * _POWERS[0]
    for k in range(1, size):
        total = mixed(total) + own[k:k + n] * _POWERS[k]
    return np.unique(mixed(total))


def _tokens(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        x = low[None, at:at + 2048] * _A + _B
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        best = np.minimum(best, (x ^ x >> np.uint32(13)).min(axis=1))
    return best


def _sketch(tokens: np.ndarray) -> list[int]:
    bits = tokens & np.uint32(3)
    return [int(np.bitwise_or.reduce(b.astype(np.uint64) << np.arange(0, 64, 2, dtype=np.uint64)).astype(np.int64)) for b in bits.reshape(4, 32)]


def _parities(shingles: np.ndarray) -> list[int]:
    """A bit is set where an odd number of shingles fall."""
    many = 64 * len(PARITIES)
    odd = np.bincount((shingles & np.uint64(many - 1)).astype(np.int64), minlength=many) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _children(tokens: np.ndarray, nodes: np.ndarray, depth: int) -> np.ndarray:
    """The nodes of a class `depth` levels below nodes: each chooses one coordinate, and a second one in part of the cases."""
    wide = tokens.astype(np.uint64)
    for _ in range(depth):
        chosen = mixed(nodes + _MIX)
        first, second = chosen & np.uint64(COORDINATES - 1), chosen >> np.uint64(8) & np.uint64(COORDINATES - 1)
        twice = (chosen >> np.uint64(32) & np.uint64(1023)) < 614
        take = lambda node, at: mixed(node * _MIX + (at << np.uint64(40)) + wide[at.astype(np.int64)])
        nodes = np.unique(np.concatenate([take(nodes, first), take(nodes[twice], second[twice])]))
    return nodes


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, id (the set's fingerprint; null if empty), s0..s3 (sketch), p0..p7 (parities) and tokens."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, ids, sketches, parities, tokens = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            own = shingle_set(text)
            best = _tokens(own) if len(own) else None
            sizes.append(len(own))
            ids.append(int(np.int64(np.uint64(xxhash.xxh64_intdigest(own.tobytes())))) if len(own) else None)
            sketches.append(_sketch(best) if len(own) else [None] * 4)
            parities.append(_parities(own) if len(own) else [None] * len(PARITIES))
            tokens.append(best.tobytes() if len(own) else None)
        return batch_of(doc_id=batch.column("doc_id"), n_shingles=pa.array(sizes, pa.int64()), id=pa.array(ids, pa.int64()),
                        **{f"s{k}": pa.array([s[k] for s in sketches], pa.int64()) for k in range(4)},
                        **{c: pa.array([p[k] for p in parities], pa.int64()) for k, c in enumerate(PARITIES)}, tokens=pa.array(tokens, pa.binary()))

    fields = ", ".join(f"{c} long" for c in ("doc_id", "n_shingles", "id", "s0", "s1", "s2", "s3", *PARITIES))
    return map_batches(docs.select("doc_id", "text"), run, f"{fields}, tokens binary")


def _nodes(rows: DataFrame, trees: int | None, depth: int) -> DataFrame:
    """node and id: the nodes `depth` levels below the roots of trees, or below the column node."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, owners = [], []
        starts = [mixed(np.arange(trees, dtype=np.uint64) + np.uint64(1))] * batch.num_rows if trees else batch.column("node").to_numpy().view(np.uint64).reshape(-1, 1)
        for id_, packed, start in zip(batch.column("id").to_pylist(), batch.column("tokens").to_pylist(), starts):
            own = _children(np.frombuffer(packed, np.uint32), start, depth)
            found.append(own)
            owners.append(np.full(len(own), id_, np.int64))
        return batch_of(node=pa.array(np.concatenate(found).view(np.int64)), id=pa.array(np.concatenate(owners)))

    return map_batches(rows.select("id", "tokens", *[] if trees else ["node"]), run, "node long, id long")


def sketch_differences(least: tuple[int, int]) -> int:
    """Differing two-bit tokens up to which a pair is confirmed: 4.5 standard deviations over what the threshold has."""
    chance = 0.75 * (1 - least[0] / least[1])
    return int(COORDINATES * chance + 4.5 * (COORDINATES * chance * (1 - chance)) ** 0.5)


def _may_link(a: str, b: str, least: tuple[int, int]) -> Column:
    """Whether sketches and parities allow a link.

    Two sets differ in as many shingles as they have differing parities, at least; at similarity s in (1 - s) / (1 + s) of both their sizes, at most.
    """
    differ = lambda x: F.bit_count((x.bitwiseOR(F.shiftright(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    xor = lambda c: F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))
    one, two = F.col(f"{a}.size"), F.col(f"{b}.size")
    odd = F.greatest(sum((F.bit_count(xor(c)) for c in PARITIES[1:]), F.bit_count(xor(PARITIES[0]))), F.abs(one - two))
    return ((sum((differ(xor(f"s{k}")) for k in range(1, 4)), differ(xor("s0"))) <= sketch_differences(least))
            & (odd * (least[1] + least[0]) <= (one + two) * (least[1] - least[0])))


def _pairs(left: DataFrame, right: DataFrame, on: list[str], least: tuple[int, int]) -> DataFrame:
    """Pairs of different components in the same cell whose sketches and parities allow a link."""
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
    met = a.join(b, [*same, F.col("a.comp") != F.col("b.comp"), _may_link("a", "b", least)])
    return met.select(F.greatest("a.id", "b.id").alias("a"), F.least("a.id", "b.id").alias("b"))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, least: tuple[int, int], repeated: bool) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach intersection / union >= least, computed from their texts."""
    pairs = stored(pairs.distinct())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    needed = small(stored(classes.select("id", F.col("first").alias("doc_id")).join(ids, "id")), BROADCAST_CLASSES)

    def same_set(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Of rows that share a doc_id only those with the class's own set."""
        own = [xxhash.xxh64_intdigest(shingle_set(t).tobytes()) == np.uint64(np.int64(i)) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist())]
        return batch.filter(pa.array(own))

    texts = docs.select("doc_id", "text").join(needed, docs["doc_id"].eqNullSafe(needed["doc_id"])).select("id", "text")
    if repeated:
        texts = map_batches(texts, same_set, "id long, text string").dropDuplicates(["id"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, np.ndarray] = {}
            keep = []
            for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
                for t in (one, two):
                    if t not in held:
                        held[t] = shingle_set(t)
                x, y = held[one], held[two]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(least[1] * common >= least[0] * (len(x) + len(y) - common))
                if len(held) > 512:
                    held.clear()
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one, two = (texts.select(F.col("id").alias(c), F.col("text").alias(n)) for c, n in (("a", "one"), ("b", "two")))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(confirm, "a long, b long")


def _mixed_nodes(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows of the nodes that hold several components, with comp, the node's size n and whether the row is its pivot."""
    rows = stored(labelled(rows, found).withColumn("h", F.xxhash64("id", "node")))
    live = (rows.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("h").alias("least"))
            .where("low != high").select("node", "n", "least"))
    return stored(rows.join(live, "node").select("node", "id", "comp", "n", (F.col("h") == F.col("least")).alias("pivot")))


def _mains(rows: DataFrame) -> DataFrame:
    """node, main (its greatest component), inside (how many members that has) and drawn, one of them by hash."""
    sizes = rows.groupBy("node", "comp").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", "node", F.lit(1))).alias("drawn"))
    return (sizes.groupBy("node").agg(F.max(F.struct("n", "comp", "drawn")).alias("main"))
            .select("node", F.col("main.comp").alias("main"), F.col("main.n").alias("inside"), F.col("main.drawn").alias("drawn")))


def near_duplicates(docs: DataFrame, least: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included) and kept, for each of docs."""
    sets = stored(sets_of(docs))
    classes = stored(sets.where("id is not null").withColumnRenamed("n_shingles", "size").groupBy("id")
                     .agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in (*SKETCH, "tokens"))))
    repeated = sets.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    sketch = classes.select("id", *SKETCH)
    with_sketch = lambda rows: rows.join(sketch, "id")

    rows = _mixed_nodes(_nodes(classes, TREES, DEPTH), None)
    leaf, large = with_sketch(rows.where(F.col("n") <= LEAF)), with_sketch(rows.where(F.col("n") > LEAF))
    pairs = _pairs(leaf, leaf, ["node"], least).union(_pairs(large.where("pivot"), large, ["node"], least))
    linked = lambda met: settled(lambda: confirmed(met, classes, docs, least, repeated))
    found = settled(lambda: components(linked(pairs), hashed=True))

    def united(found: DataFrame, met: DataFrame) -> DataFrame:
        """found with the links among the pairs that met."""
        links = linked(met)
        if not links.limit(1).count():
            return found
        return settled(lambda: components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links), hashed=True))

    rows, depth = _mixed_nodes(rows.where(F.col("n") > LEAF).select("node", "id"), found), DEPTH
    while rows.limit(1).count():
        mains = stored(_mains(rows))
        outside = with_sketch(rows.join(mains.select("node", "main"), "node").where("comp != main"))
        found = united(found, _pairs(with_sketch(mains.select("node", F.col("drawn").alias("id"), F.col("main").alias("comp"))), outside, ["node"], least))
        rows = _mixed_nodes(rows.select("node", "id"), found)
        rows = stored(rows.join(stored(_mains(rows)), "node"))
        done = (F.col("n") - F.col("inside") <= OUTSIDE) | F.lit(depth >= MOST_DEPTH)
        ready = with_sketch(rows.where(done))
        found = united(found, _pairs(ready.where("comp != main"), ready, ["node"], least))
        rows = rows.where(~done)
        if not rows.limit(1).count():
            break
        below = rows.select("node", "id").join(classes.select("id", "tokens"), "id")
        rows, depth = _mixed_nodes(_nodes(below, None, DEPTH), found), depth + DEPTH

    grouped = labelled(classes.select("id", "first"), found)
    least_doc = grouped.groupBy("comp").agg(F.min("first").alias("component_id"))
    grouped = stored(grouped.join(least_doc, "comp").select("id", "component_id"))
    out = sets.select("doc_id", "n_shingles", "id").join(grouped, "id", "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
