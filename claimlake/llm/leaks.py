"""Benchmark decontamination by SimHash of item-sized windows, as DataFrame operations only.

Texts are words between ASCII white space, with A-Z in lower case; shingles are five words (all words of a shorter item).
A window has the item's length in words (or is the whole text, if that is shorter). Windows without any shingle of an item
have similarity 0 to it, so windows are laid where a shared shingle puts the item's start. Each window's fingerprint is the
SimHash of its weighted shingles (a shingle counts as often as it occurs). The 64 bits are cut into RADIUS + 1 blocks:
fingerprints within RADIUS bits agree in at least one of them, so an equi-join by block finds all of these. Candidates are
confirmed by exact weighted similarity, the sum of least counts over the sum of greatest, from 0.8 on.

Null and empty texts and items have no hits; a doc_id may be null or repeat (its rows are told apart by their text); equal
items have a hit each; other columns are ignored; an empty table on either side gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, small, stored, table, words_of

SHINGLE, RADIUS = 5, 19
LEAST = (4, 5)
#: Rows up to which items' shingles and blocks are sent to all executors; larger tables meet by shuffles.
BROADCAST_ITEMS = 1_000_000
#: First bit and width of the RADIUS + 1 blocks: as even as 64 bits allow.
BLOCKS = [(64 * k // (RADIUS + 1), 64 * (k + 1) // (RADIUS + 1) - 64 * k // (RADIUS + 1)) for k in range(RADIUS + 1)]


def _shingles(words: str, size: str) -> Column:
    """Hashes of all runs of size words, in order."""
    return F.expr(f"transform(sequence(0, size({words}) - {size}), i -> xxhash64(slice({words}, i + 1, {size})))")


def _fingerprint(hashes: str) -> Column:
    """SimHash: each bit is that of the greater weight; an even split counts as 1."""
    bit = f"if(2 * aggregate({hashes}, 0, (n, h) -> n + cast(shiftright(h, b) & 1 as int)) >= size({hashes}), shiftleft(1L, b), 0L)"
    return F.expr(f"aggregate(transform(sequence(0, 63), b -> {bit}), 0L, (x, y) -> x | y)")


def _blocks(fingerprint: str) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.expr(f"shiftright({fingerprint}, {at}) & {(1 << width) - 1}L").alias("bits")) for k, (at, width) in enumerate(BLOCKS))))


def _similarity() -> Column:
    """Common weight of the shingles of a window and of an item."""
    return F.expr("aggregate(array_distinct(item_hashes), 0, (n, h) -> n + least(size(filter(item_hashes, x -> x = h)), size(filter(hashes, x -> x = h))))")


def find_leaks(docs: DataFrame, items: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """doc_id, text_hash, item_id, start (in words) and similarity of the best window for each item that a document holds."""
    items = (items.select("item_id", words_of(lower_ascii(F.col("text"))).alias("words")).withColumn("m", F.size("words")).where("m > 0")
             .withColumn("k", F.least("m", F.lit(SHINGLE))).withColumn("item_hashes", _shingles("words", "k")))
    items = stored(items.withColumn("item_print", _fingerprint("item_hashes")).drop("words"))
    shingles = stored(items.select("m", "k", F.posexplode("item_hashes").alias("j", "h")).distinct())
    sizes = [r["k"] for r in shingles.select("k").distinct().collect()]  # five at most
    shingles = small(shingles, BROADCAST_ITEMS)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(lower_ascii(F.col("text"))).alias("words")).withColumn("n", F.size("words"))
    windows = None
    for k in sizes:
        at = texts.where(F.col("n") >= k).select("*", F.explode(F.expr(f"sequence(0, n - {k})")).alias("at"))
        hashed = at.withColumn("h", F.xxhash64(F.array(*(F.expr(f"words[at + {i}]") for i in range(k)))))
        met = hashed.join(shingles.where(F.col("k") == k), "h")
        own = (met.withColumn("start", F.greatest(F.lit(0), F.least(F.expr("at - j"), F.expr("n - m"))))
               .select("doc_id", "text_hash", "m", "k", "start", F.expr("slice(words, start + 1, m)").alias("window")).dropDuplicates(["doc_id", "text_hash", "m", "start"]))
        windows = own if windows is None else windows.union(own)
    if windows is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, start int, similarity double")
    windows = windows.withColumn("hashes", _shingles("window", "k")).drop("window").withColumn("print", _fingerprint("hashes"))
    keyed = windows.select("doc_id", "text_hash", "m", "start", "hashes", "print", _blocks("print").alias("b")).select("*", "b.*").drop("b")
    blocks = small(stored(items.select("item_id", "m", "item_hashes", "item_print", _blocks("item_print").alias("b")).select("*", "b.*").drop("b")), BROADCAST_ITEMS)
    near = keyed.join(blocks, ["m", "block", "bits"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    common = near.dropDuplicates(["doc_id", "text_hash", "start", "item_id"]).withColumn("common", _similarity())
    sure = (common.withColumn("all", F.size("hashes") + F.size("item_hashes") - F.col("common")).where(F.col("common") * least[1] >= F.col("all") * least[0])
            .withColumn("similarity", F.col("common") / F.col("all")))
    best = sure.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("minus"))).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("best.minus")).alias("start"), "best.similarity")


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, start, similarity."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
