"""Keyed tables that streams keep current: buckets by key hash, new versions of touched buckets, and a pointer to what counts.

A merge reads the buckets that hold the keys of its batch, writes these anew under its own number, and last the pointers:
which version of each bucket counts after it. Readers follow the newest pointers, so a merge that did not end is not seen, and
one that runs again after a failure starts from the pointers before its number and replaces its own files. Buckets that a
batch has no key of are neither read nor written. Versions that no pointer names may be removed at any time.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.session import cut_lineage
from claimlake.sources.sinks import read_table

POINTERS = "bucket int, version bigint, number bigint"
BUCKETS = 16


@dataclass(frozen=True)
class KeyedTable:
    """Rows of ``schema`` under ``path``; rows that share ``keys`` are replaced together. ``buckets`` never changes.

    A task writes one bucket, so ``buckets`` follows from the size that the table may reach.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def pointers(self, before: int | None = None) -> dict[int, int]:
        """The version that counts of each bucket that has one: a number of rows that never exceeds the buckets'."""
        held = read_table(self.spark, f"{self.path}/pointers", POINTERS)
        held = held if before is None else held.filter(F.col("number") < before)
        newest = held.agg(F.max("number")).first()[0]
        return {} if newest is None else {r["bucket"]: r["version"] for r in held.filter((F.col("number") == newest) & (F.col("bucket") >= 0)).collect()}

    def _files(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int, version bigint")
        folders = [f"{self.path}/rows/bucket={b}/version={v}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(f"{self.schema}, bucket int, version bigint").option("basePath", f"{self.path}/rows").parquet(*folders)

    def read(self, before: int | None = None) -> DataFrame:
        """What counts now, or counted before the batch of that number."""
        return self._files(self.pointers(before)).drop("bucket", "version")

    def holding(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """The table's rows with a key of ``rows``: only their buckets are opened."""
        wanted = rows.select(*self.keys).distinct()
        touched = {r["b"] for r in wanted.select(self.bucket().alias("b")).distinct().collect()}  # at most as many as there are buckets
        versions = {b: v for b, v in self.pointers(before).items() if b in touched}
        return self._files(versions).drop("bucket", "version").join(wanted, list(self.keys), "left_semi")

    def merge(self, rows: DataFrame, number: int, gone: DataFrame | None = None) -> None:
        """Replaces what the table has under the keys of ``rows`` by ``rows``, and removes the keys of ``gone``."""
        rows = cut_lineage(rows.select(*[f.split()[0] for f in _fields(self.schema)]).withColumn("bucket", self.bucket()))
        keys = rows.select(*self.keys, "bucket")
        if gone is not None:
            keys = keys.unionByName(gone.select(*self.keys).withColumn("bucket", self.bucket()))
        keys = keys.distinct()
        touched = [r["bucket"] for r in keys.select("bucket").distinct().collect()]
        before = self.pointers(number)
        kept = self._files({b: v for b, v in before.items() if b in touched}).drop("version").join(keys.drop("bucket"), list(self.keys), "left_anti")
        merged = kept.unionByName(rows).withColumn("version", F.lit(number).cast("bigint"))
        filled = {r["bucket"] for r in merged.select("bucket").distinct().collect()}
        (merged.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "version").parquet(f"{self.path}/rows"))
        after = {**{b: v for b, v in before.items() if b not in touched}, **dict.fromkeys(filled, number)}
        pointers = self.spark.createDataFrame([(-1, number, number), *((b, v, number) for b, v in sorted(after.items()))], POINTERS)  # the first row: merged, even if nothing is left
        (pointers.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("number").parquet(f"{self.path}/pointers"))


def _fields(schema: str) -> list[str]:
    """The fields of a schema; commas inside of angle brackets separate none."""
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [f.strip() for f in out]
