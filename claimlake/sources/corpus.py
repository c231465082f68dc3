"""Markdown trees with YAML frontmatter as DataFrames."""
from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions import text as tx
from claimlake.schema import CORPUS_ROOTS

BINARY = "path string, modificationTime timestamp, length long, content binary"


def _located(files: DataFrame, base: str, roots: Sequence[str]) -> DataFrame:
    """Adds the relative path, its root and a sortable scan position; undecodable bytes give null text."""
    rel = F.substring_index(F.col("path"), base.rstrip("/") + "/", -1)
    text = F.expr("try_validate_utf8(cast(content as string))")
    return files.select(rel.alias("path"), text.alias("text")).select(
        "path", root_of("path").alias("root"),
        F.concat(F.format_string("%02d|", _place(roots)), F.col("path")).alias("doc_ord"), "text")


def root_of(path: str) -> Column:
    return F.when(F.locate("/", F.col(path)) > 0, F.substring_index(path, "/", 1)).otherwise("")


def _place(roots: Sequence[str]) -> Column:
    return F.coalesce(tx.rank_of(root_of("path"), ("", *roots)), F.lit(len(roots) + 1))


def scan_corpus(spark: SparkSession, base: str, roots: Sequence[str] | None = CORPUS_ROOTS) -> DataFrame:
    """(path, root, doc_ord, text) of the tree's Markdown files.

    With ``roots``: files at the top, then those roots with everything below. Without: every file but those under
    the metadata root and hidden folders, which is the range of the integrity checks.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true")
             .load(base).select("path", "content"))
    docs = _located(files, base, roots or CORPUS_ROOTS)
    if roots is None:
        return docs.filter(~F.col("path").startswith(".obsidian") & ~F.col("path").startswith("06_Metadata"))
    return docs.filter((F.col("root") == "") | F.col("root").isin(*roots))


def scan_indexes(spark: SparkSession, base: str) -> DataFrame:
    """(path, text) of the index documents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-index.md").load(f"{base.rstrip('/')}/06_Metadata/indexes").select("path", "content")
    return _located(files, base, CORPUS_ROOTS).select("path", "text")


def stream_files(spark: SparkSession, base: str, roots: Sequence[str] = CORPUS_ROOTS) -> DataFrame:
    """The same rows from a growing tree."""
    files = (spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.md")
             .option("recursiveFileLookup", "true").load(base))
    return _located(files, base, roots)


def _fences(text: Column) -> tuple[Column, Column]:
    """(frontmatter text or null, body). Fences count only as whole lines."""
    opened = text.startswith("---\n")
    close = F.locate("\n---\n", text, 4)
    ends_closed = text.endswith("\n---") & (F.length(text) >= 8)
    front = (F.when(opened & (close > 0), F.substring(text, F.lit(5), F.greatest(close - 5, F.lit(0))))
             .when(opened & ends_closed, F.substring(text, F.lit(5), F.length(text) - 8)))
    rest = (F.when(opened & (close > 0), F.substring(text, close + 5, F.length(text)))
            .when(opened & ends_closed, F.lit("")))
    return front, F.regexp_replace(rest, r"^\n+", "")


def _keys(front: str) -> dict:
    """Frontmatter as {state, meta, lists}: single values as text, lists apart."""
    import yaml
    try:
        keys = yaml.load(front, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}
    except Exception:  # whatever the file holds, one bad document must not end the scan
        return {"state": "broken"}
    if not isinstance(keys, dict):
        return {"state": "no mapping"}
    single = {str(k): str(v) for k, v in keys.items() if v is not None and not isinstance(v, list)}
    lists = {str(k): [str(x) for x in v] for k, v in keys.items() if isinstance(v, list)}
    return {"state": "ok", "keys": len(keys), "meta": single, "lists": lists}


def _read_yaml(fronts: pd.Series) -> pd.Series:
    return fronts.map(lambda f: None if f is None else json.dumps(_keys(f), ensure_ascii=False))


def parse_frontmatter(docs: DataFrame) -> DataFrame:
    """Adds ``meta`` (scalars), ``lists``, ``body``, ``corrupt`` (a finding) and ``broken`` (cannot be read) to (path, root, doc_ord, text).

    Only the frontmatter crosses to Python; texts and bodies are cut in the JVM and stay there.
    """
    front, rest = _fences(F.col("text"))
    # not to be copied into every filter that looks at its result
    read = F.pandas_udf(_read_yaml, "string").asNondeterministic()
    parsed = docs.withColumn("front", front).withColumn(
        "keys", F.from_json(read("front"), "state string, keys int, meta map<string,string>, lists map<string,array<string>>"))
    meta = F.coalesce(F.col("keys.meta"), F.create_map().cast("map<string,string>"))
    lists = F.coalesce(F.col("keys.lists"), F.create_map().cast("map<string,array<string>>"))
    is_doc = F.coalesce(F.col("keys.state") == "ok", F.lit(False))
    broken = F.col("text").isNull() | F.coalesce(F.col("keys.state") == "broken", F.lit(False))
    corrupt = broken | (F.col("text").startswith("---") & (F.coalesce(F.col("keys.keys"), F.lit(0)) == 0))
    return parsed.select("path", "root", "doc_ord", "text", meta.alias("meta"), lists.alias("lists"),
                         F.when(is_doc, rest).otherwise(F.col("text")).alias("body"), corrupt.alias("corrupt"), broken.alias("broken"))


def many(key: str) -> Column:
    """A list key that may also be written as a single value."""
    single = F.col("meta")[key]
    return F.coalesce(F.col("lists")[key], F.when(tx.filled(single).isNotNull(), F.array(single)),
                      F.array().cast("array<string>"))


def search_docs(corpus: DataFrame) -> DataFrame:
    """What search sees of each readable document: ref, title, text, sensitivity, pre_ingest."""
    meta = lambda k: F.col("meta")[k]
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md\z", "")
    first = lambda *keys: F.coalesce(*[tx.filled(meta(k)) for k in keys])
    head_keys = [F.coalesce(meta(k), F.lit("")) for k in ("id", "title", "name", "claim", "topic")]
    head = F.array_join(F.concat(F.array(*head_keys), many("aliases")), " ")
    # a rule line, an unclosed fence or empty keys leave a document that can be read, and so found
    return corpus.filter(~F.col("broken")).select(
        F.coalesce(first("id", "name"), "path").alias("ref"),
        F.coalesce(first("title", "name", "claim", "topic"), stem).alias("title"),
        tx.strip(F.concat(head, F.lit("\n"), F.col("body"))).alias("text"),
        "path", "doc_ord",
        F.coalesce(meta("sensitivity"), F.lit("")).alias("sensitivity"),
        (F.col("path").startswith("00_Inbox") & first("id").isNull()).alias("pre_ingest"))


def clips(corpus: DataFrame) -> DataFrame:
    """Inbox files without an id: what waits for ingest."""
    meta = lambda k: tx.filled(F.col("meta")[k])
    return (corpus.filter((F.col("root") == "00_Inbox") & meta("id").isNull())
            .select("path", F.coalesce(meta("url"), meta("source")).alias("url"), "text", "corrupt"))


def stream_clips(spark: SparkSession, base: str) -> DataFrame:
    """New clips as they appear in the inbox."""
    return clips(parse_frontmatter(stream_files(spark, base)))


def sources_of(corpus: DataFrame) -> DataFrame:
    meta = lambda k: F.coalesce(F.col("meta")[k], F.lit(""))
    return corpus.filter(~F.col("corrupt") & (meta("type") == "source")).select(
        meta("id").alias("id"), meta("origin").alias("origin"), meta("captured_at").try_cast("date").alias("captured_at"),
        meta("sensitivity").alias("sensitivity"), meta("url").alias("url"), "body", "path")


def claims_of(corpus: DataFrame) -> DataFrame:
    """Claim files as ledger rows; the folder comes from the path and may disagree with the status."""
    meta = lambda k: F.coalesce(F.col("meta")[k], F.lit(""))
    named = F.substring_index("path", "/", -1).startswith("claim-")
    texts = ("id", "claim_type", "status", "proposed_status", "claim", "speaker", "sensitivity", "review_after")
    return corpus.filter((F.col("root") == "10_Claims") & named & ~F.col("corrupt")).select(
        *[meta(k).alias(k) for k in texts],
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        *[many(k).alias(k) for k in ("source_refs", "evidence_refs", "superseded_by")],
        *[meta(k).try_cast("date").alias(k) for k in ("created", "updated", "last_verified")],
        tx.extract_quote(F.col("body")).alias("quote"), "path")


def pages_of(corpus: DataFrame) -> DataFrame:
    meta = lambda k: F.coalesce(F.col("meta")[k], F.lit(""))
    return corpus.filter((F.col("root") == "03_Resources") & ~F.col("corrupt")).select(
        meta("type").alias("type"), meta("name").alias("name"), meta("status").alias("status"),
        meta("sensitivity").alias("sensitivity"), many("aliases").alias("aliases"),
        many("claim_refs").alias("claim_refs"), "body", "path")
