"""The embedding job: which texts go out, what the cache already holds, and batches that survive refusals."""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.session import cut_lineage
from claimlake.sources.sinks import read_table

# Limits of the embedding job, and the prefixes of models that want them.
MAX_CHARS, BATCH, ATTEMPTS, GIVE_UP_CHARS = 16000, 96, 4, 512
NO_PREFIXES, E5_PREFIXES = ("", ""), ("passage: ", "query: ")

Embed = Callable[[list[str]], list[list[float]]]


class Unavailable(ConnectionError):
    """The service cannot answer now. Worth another attempt, and no reason to stop searching by words."""


class Rejected(ValueError):
    """The service refuses this input whatever the attempt."""


# The built-in parents are what is caught: they are the same classes in every worker, however the embedder got there.


def embed_input(docs: DataFrame, prefix: str = "") -> DataFrame:
    """(doc_id, input, key) of documents that may be sent; the key is a digest of what is sent."""
    sent = docs.filter("send") if "send" in docs.columns else docs
    return sent.select("doc_id", F.concat(F.lit(prefix), F.substring("text", 1, MAX_CHARS)).alias("input")).withColumn(
        "key", F.sha2("input", 256))


def model_tag(provider: str, model: str, dim: int | None = None) -> str:
    """Names the cache partition of one provider, model and dimension."""
    safe = "".join(c if c.isascii() and (c.isalnum() or c in "._-") else "-" for c in f"{provider}-{model}")
    return safe + (f"-{dim}d" if dim else "")


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))


def cache_missing(inputs: DataFrame, cache: DataFrame, tag: str) -> DataFrame:
    """(key, input) once per text that the cache of this model has no vector for."""
    held = cache.filter((F.col("model_tag") == tag) & usable(F.col("vector"))).select("key")
    lacking = inputs.select("key", "doc_id").join(held, "key", "left_anti").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return inputs.select("doc_id", "input").join(lacking, "doc_id").select("key", "input")


def embed_dims(vectors: DataFrame) -> DataFrame:
    """(dim, n). More than one row means that vectors of different models were mixed."""
    return vectors.filter(usable(F.col("vector"))).groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def _ask(embed: Embed, texts: list[str], wait: float) -> list[list[float]]:
    for attempt in range(ATTEMPTS):
        try:
            vectors = embed(texts)
        except ConnectionError:
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(wait * 2 ** attempt)
            continue
        if len(vectors) != len(texts):
            raise RuntimeError(f"{len(vectors)} vectors for {len(texts)} texts")
        return [[float(x) for x in v] for v in vectors]
    raise AssertionError("unreachable")


def _one(embed: Embed, text: str, wait: float) -> tuple[list[float], str]:
    """A refused text is halved until it is taken or too short to try again."""
    whole = text
    while True:
        try:
            return _ask(embed, [text], wait)[0], "ok" if text is whole else "shortened"
        except ValueError:
            if len(text) <= GIVE_UP_CHARS:
                return [], "refused"
            text = text[:len(text) // 2]


def embed(inputs: DataFrame, make_embed: Callable[[], Embed], wait: float = 1.0) -> DataFrame:
    """(key, vector, embed_status) for (key, input).

    ``make_embed`` is called once per task that has rows, inside the worker, so an empty job loads no model. A refused
    batch is asked again text by text. A text that is refused to the end gets an empty vector, which no search counts.

    An outage is data, not an error: when the service does not answer after all attempts, the batch's texts get no vector and
    the status ``unavailable``, and the task asks no more, so that a job of many batches ends soon. Any other error stops the job.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, down, nothing = None, False, (None, "unavailable")
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)  # only these become Python values
                texts, rows = part["input"].to_pylist(), []
                try:
                    if not down:
                        ask = ask or make_embed()
                        rows = [(v, "ok") for v in _ask(ask, texts, wait)]
                except ConnectionError:
                    down = True
                except ValueError:
                    for t in texts:
                        try:
                            rows.append(nothing if down else _one(ask, t, wait))
                        except ConnectionError:
                            down = True
                            rows.append(nothing)
                rows = rows or [nothing] * len(texts)
                vectors = pa.array([r[0] for r in rows], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part["key"], vectors, pa.array([r[1] for r in rows], pa.string())], names=["key", "vector", "embed_status"])

    return inputs.select("key", "input").mapInArrow(run, "key string, vector array<double>, embed_status string")


def zero_fill(vectors: DataFrame) -> DataFrame:
    """Refused texts get zeros of the common dimension, so that only words find them."""
    dim = vectors.agg(F.max(F.size("vector"))).scalar()
    empty = F.size("vector") == 0
    return vectors.withColumn("vector", F.when(empty & (dim > 0), F.array_repeat(F.lit(0.0), dim)).otherwise(F.col("vector")))


def update_cache(inputs: DataFrame, cache_path: str, make_embed: Callable[[], Embed], tag: str, wait: float = 1.0) -> DataFrame:
    """Embeds what the cache lacks, appends it, and returns (doc_id, vector). Mixed dimensions are all embedded anew.

    What the service did not answer is not kept: it has no row in the result, and the next run asks again for it alone.
    Nor does an outage while all is embedded anew touch what the cache holds; then no row is returned.
    """
    spark = inputs.sparkSession
    schema = "key string, vector array<double>, embed_status string, model_tag string"

    def read() -> DataFrame:
        return read_table(spark, cache_path, schema)

    def write(rows: DataFrame, mode: str) -> None:
        # as it comes: zeros are filled in on reading, so nothing asks for a text twice
        (rows.filter("embed_status <> 'unavailable'").withColumn("model_tag", F.lit(tag)).write.mode(mode)
         .option("partitionOverwriteMode", "dynamic").partitionBy("model_tag").parquet(cache_path))

    cache = zero_fill(read())  # a refused text is not asked for again
    missing = cache_missing(inputs, cache, tag)
    write(embed(missing, make_embed, wait), "append")
    held = lambda: zero_fill(inputs.select("doc_id", "key").join(read().filter(F.col("model_tag") == tag).select("key", "vector"), "key"))
    joined = held()
    if embed_dims(joined).count() > 1:
        anew = cut_lineage(embed(inputs.groupBy("key").agg(F.first("input").alias("input")), make_embed, wait))
        if anew.filter("embed_status = 'unavailable'").isEmpty():
            write(anew, "overwrite")
            joined = held()
        else:
            joined = joined.limit(0)
    return joined.select("doc_id", "vector")


def embed_queries(queries: DataFrame, make_embed: Callable[[], Embed], prefix: str = "", wait: float = 1.0) -> DataFrame:
    """(query_id, q, vector): queries with the vector of the prefix and their text; each text is asked for once, null where there was no answer."""
    asked = queries.select("query_id", "q", F.concat(F.lit(prefix), "q").alias("input")).withColumn("key", F.sha2("input", 256))
    done = cut_lineage(embed(asked.select("key", "input").dropDuplicates(["key"]), make_embed, wait))
    vectors = zero_fill(done.filter("embed_status <> 'unavailable'")).select("key", "vector")
    return asked.join(vectors, "key", "left").select("query_id", "q", "vector")
