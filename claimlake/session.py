"""Session defaults and the checkpoint rule."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# AQE sizes shuffles and splits skewed join partitions at run time, so the static partition count only
# has to be an upper bound on a cluster.
CONFIG = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str = "claimlake", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the defaults above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in CONFIG.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder that the cluster names, and reads it from there.

    A local session without such a folder gets one of its own. A cluster without one is an error: some operators need what
    they have written to stay as it is.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="claimlake-"))
    return df.checkpoint()
