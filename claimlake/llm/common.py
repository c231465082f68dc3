"""What the operators share: reading tables, the shared folder, Arrow batches and words."""
from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which the shuffle files of a statement go when it ends.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
_steps: ContextVar[list[str] | None] = ContextVar("steps", default=None)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session without one a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder, so that lost executors or later uses don't run its plan again.

    With checkpoints, loops slowed with every round, probably by the constraints such a frame keeps of its plan; with files they don't.
    Its shuffle files go as soon as it is written; else they would stay until the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/stored-{uuid4().hex}"
    before = spark.conf.get(FILES_GO, "false")
    spark.conf.set(FILES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FILES_GO, before)
    if (steps := _steps.get()) is not None:
        steps.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame | tuple[DataFrame, ...]]) -> DataFrame | tuple[DataFrame, ...]:
    """What make() gives, one table or several, stored; the files of all steps that make() stored on the way go, so nothing else may read those."""
    own: list[str] = []
    outer = _steps.set(own)
    try:
        made = make()
    finally:
        _steps.reset(outer)
    out = tuple(map(stored, made)) if isinstance(made, tuple) else stored(made)
    context = SparkSession.active().sparkContext
    for path in map(context._jvm.org.apache.hadoop.fs.Path, own):
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return out


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df, stored, and how many rows it has, counted as they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def small(df: DataFrame, rows: int) -> DataFrame:
    """A stored table marked for broadcast if it has at most that many rows; otherwise it meets its partner by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """function over each Arrow batch; a batch without a result is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (made := function(batch)) is not None:
                yield made
    return df.mapInArrow(run, schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values scattered over all bits."""
    x = x ^ x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text: what lies between runs of space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")
