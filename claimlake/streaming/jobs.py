"""The incremental forms: the same operators fed by streams.

What a later batch needs of earlier ones lies in streaming state or in keyed tables (`current`), of which a batch opens the buckets
of its own keys only; a batch is computed once and then written to all its outputs. Logs and audits are tables partitioned
by micro-batch. A batch that is run again after a failure replaces its own partitions and versions.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimlake.functions import text as tx
from claimlake.operators import intake, reviews, search
from claimlake.session import cut_lineage
from claimlake.skew import latest_per_key
from claimlake.sources.sinks import read_table
from claimlake.streaming import command_state
from claimlake.streaming.current import KeyedTable

SOURCES = ("id string, origin string, captured_at date, sensitivity string, url string, body string, path string, "
           "ord bigint, report array<struct<kind:string,before:int,after:int>>, batch bigint")
NAMES = "file string, id string, path string"
NUMBERS = "captured_at date, id string, path string"
CLAIMS = ("claim_id string, claim_type string, status string, proposed_status string, claim string, speaker string, "
          "source_refs array<string>, evidence_refs array<string>, sensitivity string, quote string, "
          "superseded_by array<string>, created date, updated date, last_verified date, folder string")
REVIEWED = "learning_id string, passes bigint, n_reviews bigint, last struct<date:date,passed:boolean>, batch bigint"
ENTRIES = "id string, ord bigint, line string, batch bigint"
POSTINGS = "doc_id bigint, dl int, term string, tf bigint"
DOCS = "doc_id bigint, dl int"
TERMS = "term string, df bigint"
SPREAD = "df bigint, n_terms bigint"
SIZES = "n_docs bigint, total_dl bigint, one int"


def _write(df: DataFrame, path: str, batch: int) -> None:
    (df.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(each).start())


def ingest(clips: DataFrame, path: str, checkpoint: str, as_of: str) -> StreamingQuery:
    """Clips into ``path``/sources, /quarantine and /log. Numbers and titles continue those of earlier batches.

    Of these a batch reads the file names that its own titles ask for (/names) and the last number of its day (/numbers).
    """
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        names, numbers = KeyedTable(spark, f"{path}/names", NAMES, ("file",)), KeyedTable(spark, f"{path}/numbers", NUMBERS, ("captured_at",), 1)
        batch = cut_lineage(batch)
        asked = batch.select(intake.clip_file(F.col("title")).alias("file")).dropna()
        held = names.holding(asked, number).select("id", "path").unionByName(numbers.read(number).select("id", "path"))
        sources, bad, _ = intake.ingest_sources(batch, held, as_of)
        sources = cut_lineage(sources)
        _write(sources, f"{path}/sources", number)
        _write(bad, f"{path}/quarantine", number)
        _write(intake.capture_log(sources), f"{path}/log", number)
        names.merge(sources.select(F.substring_index("path", "/", -1).alias("file"), "id", "path"), number)
        last = intake.top_numbers(sources.select("id", "path").unionByName(numbers.read(number).select("id", "path")), "source")
        numbers.merge(last.select(F.col("day").alias("captured_at"), tx.doc_id("source", F.col("day"), F.col("top")).alias("id"), F.lit("").alias("path")), number)
    return _start(clips, each, checkpoint)


def command_claims(commands: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Commands into ``path``/claims, the claims as they are now, and /audit. What a command meets lies in streaming state."""
    def each(batch: DataFrame, number: int) -> None:
        rows = cut_lineage(batch)  # the state moves on once
        _write(command_state.audit_of(rows), f"{path}/audit", number)
        _claims(rows.sparkSession, path).merge(command_state.claims_of(rows), number)

    conf = commands.sparkSession.conf
    before = conf.get(command_state.PROVIDER)
    conf.set(command_state.PROVIDER, command_state.ROCKS)
    try:
        return _start(command_state.stateful(commands), each, checkpoint, "update")
    finally:
        conf.set(command_state.PROVIDER, before)


def _claims(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, f"{path}/claims", CLAIMS, ("claim_id",))


def current_claims(spark: SparkSession, path: str) -> DataFrame:
    return _claims(spark, path).read()


def _newest(df: DataFrame, key: str) -> DataFrame:
    return latest_per_key(df, [key], F.col("batch"))


def review_items(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Reviews summed up per item in streaming state; each batch writes the items it changed."""
    return _start(reviews.review_summary(stream), lambda df, n: _write(df, f"{path}/reviewed", n), checkpoint, "update")


def reviewed_items(items: DataFrame, path: str) -> DataFrame:
    """Items (id, level, next_review, …) with the reviews so far."""
    done = _newest(read_table(items.sparkSession, f"{path}/reviewed", REVIEWED), "learning_id")
    merged = items.join(done.drop("batch").withColumnRenamed("learning_id", "id"), "id", "left")
    level, due = reviews.schedule(F.col("level"), F.col("passes"), F.col("last"))
    return (merged.withColumn("next_review", F.when(F.col("last").isNotNull(), due).otherwise(F.col("next_review")))
            .withColumn("level", F.when(F.col("last").isNotNull(), level).otherwise(F.col("level")))
            .withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0))).drop("passes", "last"))


def upsert_index(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Index entries (id, ord, line): the newest line per id in streaming state."""
    newest = entries.groupBy("id").agg(F.max("ord").alias("ord"), tx.squash(F.max_by("line", "ord")).alias("line"))
    return _start(newest, lambda df, n: _write(df, f"{path}/entries", n), checkpoint, "update")


def current_index_lines(spark: SparkSession, path: str) -> DataFrame:
    return _newest(read_table(spark, f"{path}/entries", ENTRIES), "id").select("id", "line")


def index_documents(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Documents (doc_id, seq, text; null text removes) into an index. Only what arrives is tokenized, and only buckets that hold
    an arriving document, or a term whose frequency changes, are read and written anew; counts change by signed sums."""
    def each(batch: DataFrame, number: int) -> None:
        newest = cut_lineage(latest_per_key(batch.select("doc_id", "seq", "text"), ["doc_id"], F.col("seq")))
        fresh = search.build_index(newest.filter("text is not null")).checkpointed()
        t = _index_tables(batch.sparkSession, path)
        gone, gone_docs = cut_lineage(t["postings"].holding(newest, number)), cut_lineage(t["docs"].holding(newest, number))
        delta = cut_lineage(search.term_changes(fresh.postings, gone))
        moved = cut_lineage(search.moved_terms(delta, t["terms"].holding(delta, number)))
        sizes = search.moved_sizes(t["sizes"].read(number), fresh.docs, gone_docs)
        spread = t["spread"].read(number)
        t["postings"].merge(fresh.postings, number, newest)
        t["docs"].merge(fresh.docs, number, newest)
        t["terms"].merge(moved.filter("df > 0").select("term", "df"), number, moved)
        t["spread"].merge(search.moved_spread(spread, moved), number, spread)
        t["sizes"].merge(sizes.withColumn("one", F.lit(1)), number)
    return _start(changes, each, checkpoint)


def _index_tables(spark: SparkSession, path: str) -> dict[str, KeyedTable]:
    shapes = {"docs": (DOCS, "doc_id"), "postings": (POSTINGS, "doc_id"), "terms": (TERMS, "term"), "spread": (SPREAD, "df", 1), "sizes": (SIZES, "one", 1)}
    return {name: KeyedTable(spark, f"{path}/{name}", schema, (key,), *buckets) for name, (schema, key, *buckets) in shapes.items()}


def current_index(spark: SparkSession, path: str) -> search.Index:
    """The index as of the last batch; nothing is counted."""
    t = {name: table.read() for name, table in _index_tables(spark, path).items()}
    return search.Index(t["docs"], t["postings"], t["terms"], search.stats_of(t["sizes"].drop("one"), t["spread"]), t["spread"])
