"""The prefix trie of conversations: a node for each distinct sequence of first turns, with what shares it and what that saves.

A turn becomes the MD5 of its role and text and its number of words, and a conversation the row of its turns' digests, its path,
which sorts before all paths that it starts. Splitters, paths and ids of a bounded sample of conversations, cut the order of
(path, id) into shards of about equally many turns; copies of one conversation are cut as well, as ids order them. All starts of
splitter paths are the skeleton trie, which every task gets. A node that isn't in it lies inside one shard, and that shard's
task finishes it: sorted paths give the nodes in preorder, and sums go up level by level. For skeleton nodes shards give
partial sums, which are added by node; one last step adds up along the skeleton alone.

Bounds: a task holds one shard, some 20 bytes a turn and 100 a node, so one conversation's path, never its texts. The skeleton has
as many nodes as there are turns in all splitters. Members' ids of a skeleton node go as pieces, in order, through one digest.

Null roles and texts are empty; turns are ordered by number, null first, those with the same number by digest; rows repeated
in full are further turns; rows without conv_id belong to no conversation and are left out. Other columns, whatever their names,
are not read. An empty table has no nodes, not even a root.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a turn's digest.
WIDE = 16
#: Turns of a shard at most, about, and conversations drawn for each splitter.
SHARD_TURNS, DRAWN = 500_000, 32
#: Ids in one piece of a member list.
PIECE_IDS = 256
#: Skeleton nodes that are broadcast to their children, 16 bytes each; more meet them by a shuffle.
MOST_SENT = 500_000
EMPTY = hashlib.sha256().hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
MADE = f"{NODES}, skeleton long, parent_skeleton long, words long, shard long, piece long, ends string"
KINDS = {"long": pa.int64(), "string": pa.string()}


def _batch(schema: str, **columns) -> pa.RecordBatch:
    """Columns of the schema; those not given are null."""
    n = len(next(iter(columns.values())))
    fields = [f.split() for f in schema.split(", ")]
    return batch_of(**{name: pa.array(columns[name], KINDS[kind]) if name in columns else pa.nulls(n, KINDS[kind]) for name, kind in fields})


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): per conversation the digests and numbers of words of its turns, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.struct("turn", key.alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("turn"))
    both = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words")))
    return turns.groupBy("conv_id").agg(both.alias("turns"))


def _shared(a: bytes, b: bytes) -> int:
    """How many first turns two paths share."""
    low, high = 0, min(len(a), len(b)) // WIDE
    if a[:high * WIDE] == b[:high * WIDE]:
        return high
    while high - low > 1:  # shared up to low, not up to high
        at = (low + high) // 2
        low, high = (at, high) if a[low * WIDE:at * WIDE] == b[low * WIDE:at * WIDE] else (low, at)
    return low


class Trie:
    """The nodes of sorted paths in preorder: depth, parent, the first path that has it; node 0 is the root."""

    def __init__(self, paths: list[bytes]):
        parent, depth, row, ends, known, last = [-1], [0], [0], [], [0], b""
        for i, path in enumerate(paths):
            shared, size = _shared(last, path), len(path) // WIDE
            new = range(len(parent), len(parent) + size - shared)
            parent += [known[shared], *new[:-1]] if new else []
            depth += range(shared + 1, size + 1)
            row += [i] * len(new)
            known[shared + 1:] = new
            ends.append(known[size])
            last = path
        self.parent, self.depth, self.row, self.ends = (np.array(x, np.int64) for x in (parent, depth, row, ends))

    def way(self, node: int) -> list[int]:
        """The nodes from the root to this one."""
        found = []
        while node >= 0:
            found.append(node)
            node = int(self.parent[node])
        return found[::-1]


def sum_up(parent: np.ndarray, depth: np.ndarray, sums: list[np.ndarray], least: np.ndarray | None = None) -> None:
    """Adds each node to its parent, deepest first, so that every node holds its whole subtree."""
    order = np.argsort(-depth, kind="stable")
    for nodes in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        if depth[nodes[0]]:
            for x in sums:
                np.add.at(x, parent[nodes], x[nodes])
            if least is not None:
                np.minimum.at(least, parent[nodes], least[nodes])


class Skeleton:
    """The splitters, the trie of their paths, and for each splitter the nodes of its path."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.trie = Trie([path for path, _ in splitters])
        self.ways = [self.trie.way(end) for end in self.trie.ends.tolist()]

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))

    def __len__(self) -> int:
        return len(self.trie.parent)

    def known(self, shard: int, paths: list[bytes], trie: Trie) -> np.ndarray:
        """For each node of a shard's trie its node here, or -1: only its two bordering splitters can share nodes with it."""
        found = np.full(len(trie.parent), -1, np.int64)
        found[0] = 0
        new = np.flatnonzero(np.diff(trie.row, append=len(paths)))
        starts = np.append(0, new + 1)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            for at in (shard - 1, shard):
                if 0 <= at < len(self.splitters):
                    upto, way = _shared(paths[trie.row[a]], self.splitters[at][0]), self.ways[at]
                    for node in range(a, b):
                        if (d := int(trie.depth[node])) > upto:
                            break
                        found[node] = way[d]
        return found


def finish(shard: int, ids: np.ndarray, paths: list[bytes], words: np.ndarray, starts: np.ndarray, skeleton: Skeleton) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard, whose rows are sorted: finished ones, and partial sums of those in the skeleton."""
    trie = Trie(paths)
    size, known = len(trie.parent), skeleton.known(shard, paths, trie)
    inside, below = known < 0, trie.depth > 0
    own = np.zeros(size, np.int64)
    own[below] = words[starts[trie.row[below]] + trie.depth[below] - 1]
    convs, least = np.bincount(trie.ends, minlength=size), np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(least, trie.ends, ids)
    sum_up(trie.parent, trie.depth, [convs], least)
    children = np.bincount(trie.parent[inside], minlength=size)
    leaves = (inside & (children == 0)).astype(np.int64)
    saved = np.where(inside, (convs - 1) * own, 0)
    sum_up(trie.parent, trie.depth, [leaves, saved])

    digests, pieces = np.full(size, EMPTY, object), []
    borders = np.append(np.flatnonzero(np.diff(trie.ends, prepend=-1)), len(ids)).tolist()
    for a, b in zip(borders[:-1], borders[1:]):
        node = int(trie.ends[a])
        if inside[node]:
            digests[node] = hashlib.sha256(",".join(map(str, ids[a:b].tolist())).encode()).hexdigest()
        else:
            pieces += [(int(known[node]), shard, i, ",".join(map(str, ids[i:min(b, i + PIECE_IDS)].tolist()))) for i in range(a, b, PIECE_IDS)]

    def rows(chosen: np.ndarray, **more) -> pa.RecordBatch:
        return _batch(MADE, conv_id=least[chosen], depth=trie.depth[chosen], n_convs=convs[chosen], n_children=children[chosen],
                      n_leaves=leaves[chosen], saved_tokens=saved[chosen], **more)

    chosen = np.flatnonzero(inside)
    for some in np.split(chosen, range(50_000, len(chosen), 50_000)) if len(chosen) else []:
        up = trie.parent[some]
        hangs = known[up] >= 0
        yield rows(some, parent_conv_id=pa.array(least[up], mask=hangs), parent_skeleton=pa.array(known[up], mask=~hangs), ends_sha256=digests[some])
    chosen = np.flatnonzero(~inside)
    yield rows(chosen, skeleton=known[chosen], words=own[chosen])
    for i in range(0, len(pieces), 10_000):
        yield _batch(MADE, **dict(zip(("skeleton", "shard", "piece", "ends"), zip(*pieces[i:i + 10_000]))))


def draw_skeleton(rows: DataFrame, n: int, turns: int) -> tuple[Skeleton, int]:
    """Splitters at equal numbers of turns in a sample of about `DRAWN` conversations a shard, and the number of shards."""
    spark = rows.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    drawn = sorted((bytes(r["path"]), r["conv_id"]) for r in rows.select("path", "conv_id").sample(min(1.0, DRAWN * shards / max(1, n)), 7).collect())
    weight = np.cumsum([len(path) // WIDE + 1 for path, _ in drawn], dtype=np.int64)
    at = np.searchsorted(weight, weight[-1] * np.arange(1, shards) // shards) if drawn else []
    skeleton = Skeleton([drawn[i] for i in sorted({int(i) for i in at})])
    return skeleton, len(skeleton.splitters) + 1


def _dealt(rows: DataFrame, skeleton: Skeleton, shards: int) -> DataFrame:
    """The rows, each shard in a partition of its own and sorted."""
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [skeleton.shard(p, c) for p, c in zip(batch["path"].to_pylist(), batch["conv_id"].to_pylist())]
            yield batch_of(**{name: batch[name] for name in ("conv_id", "path", "words")}, shard=pa.array(where, pa.int32()))
    numbered = rows.mapInArrow(number, "conv_id long, path binary, words array<int>, shard int")
    return numbered.repartitionById(shards, "shard").sortWithinPartitions("path", "conv_id")


def _finished(dealt: DataFrame, skeleton: Skeleton) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, paths, words, sizes, shard = [], [], [], [], 0
        for batch in batches:
            if batch.num_rows:
                shard = batch["shard"][0].as_py()
                ids.append(batch["conv_id"].to_numpy(zero_copy_only=False))
                paths += batch["path"].to_pylist()
                words.append(batch["words"].flatten().to_numpy(zero_copy_only=False))
                sizes.append(batch["words"].value_lengths().to_numpy(zero_copy_only=False))
        if paths:
            ends = np.cumsum(np.concatenate(sizes), dtype=np.int64)
            yield from finish(shard, np.concatenate(ids), paths, np.concatenate(words), np.append(0, ends[:-1]), skeleton)
    return dealt.mapInArrow(run, MADE)


def _digests(pieces: DataFrame) -> DataFrame:
    """(skeleton, ends_sha256): the pieces of each node, which come in order, through one digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for at, ends in zip(batch["skeleton"].to_pylist(), batch["ends"].to_pylist()):
                if at != node:
                    done += [(node, digest.hexdigest())] if digest else []
                    node, digest = at, hashlib.sha256(ends.encode())
                else:
                    digest.update(f",{ends}".encode())
            if done:
                yield batch_of(skeleton=pa.array([d[0] for d in done], pa.int64()), ends_sha256=[d[1] for d in done])
        if digest:
            yield batch_of(skeleton=pa.array([node], pa.int64()), ends_sha256=[digest.hexdigest()])
    return pieces.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "piece").mapInArrow(run, "skeleton long, ends_sha256 string")


def _reduced(made: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The skeleton's nodes: partial sums added by node, then, over these few rows, along the skeleton."""
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    sums = made.where("skeleton is not null and ends is null").groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *total)
    digests = _digests(made.where("ends is not null").select("skeleton", "shard", "piece", "ends"))
    parent, depth = skeleton.trie.parent, skeleton.trie.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (parts := [b for b in batches if b.num_rows]):
            return
        x = pa.Table.from_batches(parts).sort_by("skeleton")
        conv, words, convs, children, leaves, saved = (x[c].to_numpy().astype(np.int64) for c in ("conv_id", "words", "n_convs", "n_children", "n_leaves", "saved_tokens"))
        children += np.bincount(parent[1:], minlength=len(parent))
        more_leaves, more_saved = (children == 0).astype(np.int64), (convs - 1) * words
        sum_up(parent, depth, [more_leaves, more_saved])
        yield _batch(f"skeleton long, {NODES}", skeleton=np.arange(len(parent)), conv_id=conv, depth=depth, parent_conv_id=pa.array(conv[parent], mask=parent < 0), n_convs=convs,
                     n_children=children, n_leaves=leaves + more_leaves, saved_tokens=saved + more_saved, ends_sha256=[d or EMPTY for d in x["ends_sha256"].to_pylist()])
    return sums.join(digests, "skeleton", "left").repartition(1).mapInArrow(run, f"skeleton long, {NODES}")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turns) as `sequences` gives them; columns as in `NODES`.

    n_children, n_leaves (childless nodes) and saved_tokens (each node's words, once for every member but one) are of the node's
    whole subtree, which holds the node; ends_sha256 is the digest of the ids whose last turn the node is.
    """
    seen = Observation()
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    rows = conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = stored(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("turns")))
    skeleton, shards = draw_skeleton(rows, seen.get["n"], seen.get["turns"])
    made = stored(_finished(_dealt(rows, skeleton, shards), skeleton))
    top = stored(_reduced(made, skeleton))
    up = top.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("up"))
    names = [f.split()[0] for f in NODES.split(", ")]
    inside = made.where("skeleton is null").join(F.broadcast(up) if len(skeleton) <= MOST_SENT else up, "parent_skeleton", "left")
    return inside.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).select(*names).unionByName(top.select(*names))


def rebuilt(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations (conv_id, turns) whose first turns, some number below `most` by the id's CRC-32, are those of their family's first."""
    base, head = F.col("conv_id") - F.col("conv_id") % family, F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = conversations.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    none: Column = F.slice("turns", 1, F.lit(0))
    joined = conversations.withColumns({"_base": base, "_h": head.cast("int")}).join(heads, "_base", "left")
    first = F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h"))
    return joined.select("conv_id", F.concat(first, F.slice("turns", F.col("_h") + 1, F.size("turns") + 1)).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))
