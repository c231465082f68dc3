"""Token-id output: documents in ascending order as range-coded frames, and their way back.

A table of frames is a folder of Parquet files whose rows hold one binary frame each. A frame has whole documents only: the
list of their ids and lengths, and the code of all their token ids (`rangecoder`), cut into blocks that are reset and
checksummed one by one. Spark commits the files, so a task that runs again replaces its own.

Null texts count as empty (one end id), null doc_ids come first, equal doc_ids follow each other in an order by text hash,
other columns are ignored, an empty table gives an empty folder of frames.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rangecoder, tokens
from .common import batch_of, shared_folder, small, table

#: Ids after which a frame ends with the document at hand.
FRAME_IDS = 1 << 22
#: Rows up to which the frames' first positions are sent to all executors.
BROADCAST_FRAMES = 200_000
_FRAME = "part long, frame long, n_ids long, doc_ids array<long>, lengths array<long>, code binary"


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, frame_ids: int = FRAME_IDS) -> None:
    """Writes the frames of docs (doc_id, text), in ascending doc_id order over all parts."""
    vocabulary = vocabulary or tokens.vocabulary()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), tokens.encoder(vocabulary)
        frame, doc_ids, packed, size = 0, [], [], 0
        limit = frame_ids * encoder.dtype.itemsize

        def finished() -> pa.RecordBatch:
            lengths = [len(p) // encoder.dtype.itemsize for p in packed]
            code = rangecoder.encode(np.frombuffer(b"".join(packed), encoder.dtype))
            return batch_of(part=[part], frame=[frame], n_ids=[sum(lengths)], doc_ids=pa.array([doc_ids], pa.list_(pa.int64())),
                            lengths=pa.array([lengths], pa.list_(pa.int64())), code=[code])

        for batch in batches:
            texts = batch.column("text")
            for start, end in tokens.portions(texts):
                for doc_id, ids in zip(batch.column("doc_id")[start:end].to_pylist(), encoder.encode(texts[start:end].to_pylist())):
                    doc_ids.append(doc_id)
                    packed.append(ids)
                    size += len(ids)
                    if size >= limit:
                        yield finished()
                        frame, doc_ids, packed, size = frame + 1, [], [], 0
        if doc_ids:
            yield finished()

    tie = F.xxhash64("text")
    (docs.select("doc_id", "text").repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
     .mapInArrow(frames, _FRAME).write.mode("overwrite").parquet(path))


def frame_starts(frames: DataFrame) -> DataFrame:
    """part, frame and the ids of all frames before it: sums within a part, over 1,024 parts, and over those groups."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    group = F.floor(F.col("part") / 1024).alias("group")
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", group, "n")
    groups = parts.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.select("group", F.coalesce(F.sum("n").over(before(Window.orderBy("group"))), F.lit(0)).alias("g"))
    parts = parts.select("part", "group", F.coalesce(F.sum("n").over(before(Window.partitionBy("group").orderBy("part"))), F.lit(0)).alias("p"))
    return (frames.select("part", "frame", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("frame"))), F.lit(0)).alias("f"))
            .join(parts.join(groups, "group"), "part").select("part", "frame", (F.col("f") + F.col("p") + F.col("g")).alias("base")))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decodes the frames: doc_id, start, n_tokens, ids_crc32 and, unless with_ids is false, the ids. A damaged block raises."""
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                wide = rangecoder.decode(row["code"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                own = [wide[e - n:e] for e, n in zip(ends.tolist(), lengths.tolist())]
                made = {"part": [row["part"]] * len(own), "frame": [row["frame"]] * len(own), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "at": pa.array(ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())}
                if with_ids:
                    made["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(wide.astype(np.int32)))
                yield batch_of(**made)

    frames = spark.read.parquet(path)
    schema = "part long, frame long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    starts = small(frame_starts(frames.select("part", "frame", "n_ids")), BROADCAST_FRAMES)
    return (frames.select("part", "frame", "doc_ids", "lengths", "code").mapInArrow(documents, schema).join(starts, ["part", "frame"])
            .select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and reads them back: doc_id, start, n_tokens, ids_crc32."""
    path = f"{shared_folder(spark)}/tokens-{uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, with_ids=False)
