"""From documents to packed sequences: language ID, line dedup, near-dedup, decontamination and packing.

Every stage takes what its predecessor kept, written as Parquet in the shared folder and read again. All but the last return
the columns of documents. Documents with null texts have no language and go in the first stage; an empty table passes
through all stages; further columns of documents are carried along.
"""
from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm.common import shared_folder, small, stored, table
from claimlake.llm.language import classify, learn
from claimlake.llm.leaks import find_leaks
from claimlake.llm.lines import dedup_lines
from claimlake.llm.near import near_duplicates
from claimlake.llm.packing import pack

#: A document stays if its language has at least this chance.
LEAST_CHANCE = 0.5
#: Similarity of near-duplicates, as a fraction.
NEAR = (80, 100)
#: Keys of rows that go up to which they are sent to all executors; more meet the rows by a shuffle.
BROADCAST_ROWS = 300_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that is likelier than all others together, go."""
    langs, matrix = learn(docs)
    found = classify(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c in ("lang_pred", "score")}), langs, matrix)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_CHANCE)).drop("lang_pred", "score")
    return found.withColumnsRenamed({f"own_{c}": c for c in ("lang_pred", "score") if c in docs.columns}).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of similar lines stays in the corpus; a document whose lines all went, goes."""
    found = dedup_lines(docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("own_")))
    text = found["text"]
    fields = [text if c == "text" else F.length(text).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"own_.{c}") for c in docs.columns]
    return found.where("n_kept > 0 or n_lines = 0").select(*fields)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the first by doc_id (null first) and text hash, and of rows that share both the first by the hash of their columns.

    Texts without words are in no group.
    """
    key = F.xxhash64("doc_id", "text").alias("near_key")
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"), NEAR).withColumnRenamed("doc_id", "near_key")
    own = stored(found.groupBy("near_key").agg(F.min("component_id").alias("comp"), F.max("n_shingles").alias("n"), F.count("*").alias("rows")))
    places = docs.select(key, F.struct("doc_id", F.xxhash64("text")).alias("place")).distinct()
    first = F.min_by(F.struct("near_key", "rows"), "place").alias("first")
    stay = stored(own.where("n > 0").join(places, "near_key").groupBy("comp").agg(first).select("first.near_key", (F.col("first.rows") > 1).alias("once")))
    # What goes is often little, and then no text has to be dealt.
    not_once = own.where("n > 0").select("near_key").join(stay.where("not once"), "near_key", "left_anti")
    once = small(stored(stay.where("once").select("near_key")), BROADCAST_ROWS)
    keyed = docs.select("*", key)
    kept = keyed.join(small(stored(not_once), BROADCAST_ROWS), "near_key", "left_anti")
    order = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))
    one = keyed.join(once, "near_key", "left_semi").groupBy("near_key").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return kept.select(*docs.columns).union(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak_id"), "text_hash").distinct()
    leaks = small(stored(leaks), BROADCAST_ROWS)
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak_id"]) & (F.xxhash64(docs["text"]) == leaks["text_hash"]), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return pack(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, docs = f"{shared_folder(spark)}/pipeline-{uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
