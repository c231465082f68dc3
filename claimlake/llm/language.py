"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of other characters than letters becomes one blank, and each pair and triple of characters
is hashed to a bucket. Spark adds up the buckets of labelled documents; the matrix of log probabilities (buckets x
languages, in whole numbers, so that sums don't depend on the order of batches) is broadcast, and tasks score whole texts.

A null text, an empty one or one without a letter is `und` with score 0, and so is every text if nothing was learned. A
null lang isn't learned from. Rows with a null doc_id are never held out nor learned from. Equal chances go to the language
that sorts first. Other columns are kept by `classify` unless their names clash with its own (lang_pred, score), which it replaces.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, table
from .tokens import portions

BUCKETS = 1 << 15
#: About so many labelled documents, chosen by the hash of their doc_id, are learned from, and so many languages at most.
LEARN_FROM, LANGUAGES = 20_000, 512
_UNIT = 4096  # parts of a log probability
_STEP = 1 << 20  # characters at a time
_ROWS = 1 << 16  # rows of the matrix added up at a time
_letters: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """The buckets of a text's pairs and triples; empty if it has no letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, np.uint32(0))
    keep = codes != 0
    if not keep.any():
        return np.zeros(0, np.int64)
    keep[1:] |= codes[:-1] != 0
    codes = codes[keep]
    pairs = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    triples = (pairs[:-1] ^ pairs[:-1] >> np.uint32(15)) * np.uint32(0x2C1B3C6D) + codes[2:] * np.uint32(0xC2B2AE3D)
    return np.concatenate([(h ^ h >> np.uint32(16)) * np.uint32(0x45D9F3B) >> np.uint32(32 - BUCKETS.bit_length() + 1) for h in (pairs, triples)]).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    """The texts of a batch, of which a portion at a time become Python values."""
    column = batch.column("text")
    for start, end in portions(column):
        yield from column[start:end].to_pylist()


def learn(docs: DataFrame, learn_from: int = LEARN_FROM) -> tuple[list[str], np.ndarray]:
    """The languages in order and their matrix, from documents that have a lang and aren't held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = int(min(1.0, learn_from / max(1, labelled.count())) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch)):
                own = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                own[-1] += 1
                for at in range(0, len(text or ""), _STEP):
                    own[:-1] += np.bincount(grams(text[at:at + _STEP]), minlength=BUCKETS)
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            yield batch_of(lang=[lang] * len(used), bucket=used, n=own[used])

    counted = (labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 20)) < share).select("lang", "text")
               .mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(counted["lang"].unique())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[counted["bucket"], np.searchsorted(np.array(langs, object), counted["lang"])] = counted["n"]
    if not langs:
        return [], counts
    chances = (counts[:-1] + 0.5) / (counts[:-1] + 0.5).sum(axis=0)
    prior = counts[-1] / counts[-1].sum()
    return langs, np.rint(np.log(np.vstack([chances, prior])) * _UNIT).astype(np.int32)


def classify(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """docs with lang_pred and score: the language of the greatest probability, and that probability."""
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = model.value
        for batch in batches:
            preds, scores = [], []
            for text in _texts(batch):
                total, seen = np.zeros(len(names), np.int64), 0
                for at in range(0, len(text or "") if names else 0, _STEP):
                    own = grams(text[at:at + _STEP])
                    seen += len(own)
                    for k in range(0, len(own), _ROWS):
                        total += logs.take(own[k:k + _ROWS], axis=0).sum(axis=0, dtype=np.int64)
                if not seen:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                total += logs[-1]
                best = int(total.argmax())
                preds.append(names[best])
                scores.append(float(1 / np.exp((total - total[best]) / _UNIT).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*kept).mapInArrow(score, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = table(spark, sf_dir, "documents")
    langs, matrix = learn(docs)
    found = classify(docs.select("doc_id", "text"), langs, matrix)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
