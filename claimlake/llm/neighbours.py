"""Approximate nearest neighbours by inner product: p-stable hashing with query-directed multiprobe.

Largest inner product becomes least distance: an indexed vector, divided by the greatest norm, gets one more component that
brings it to length 1; a query is scaled to length 1 and gets 0 there. A table hashes to floor((a.x + b) / w) for HASHES normal
vectors a. A query visits its own bucket and then those one step away in some of the hashes, in the order of their estimated
success: the sum of squared distances to the walls between. Candidates of all tables are merged and ranked by exact products.

The width w and the number of visited buckets are fitted on a sample: FIT_ROWS rows and FIT_QUERIES queries, chosen by hash.
Every row is indexed. Equal vectors are indexed once, with their NEIGHBOURS + 1 smallest ids, which is all that a result can
hold of them. A bucket is cut into blocks of BLOCK vectors and BLOCK queries, so no task holds more of it.

Vectors that are null or zero, or hold null, NaN or infinity, take no part, nor do rows with a null vec_id. Vectors of
different lengths never meet. An empty table gives no rows; other columns are ignored; repeated ids count as candidates each.
"""
from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored, table

TABLES, HASHES, NEIGHBOURS, BLOCK = 4, 4, 20, 4096
FIT_ROWS, FIT_QUERIES, FIT_RECALL = 8192, 256, 0.96
#: Rows up to which the table of bucket sizes is sent to all executors.
BROADCAST_BUCKETS = 100_000
_STEPS = np.array(list(product((0, -1, 1), repeat=HASHES)))
KEY = ["k1", "k2"]


def _planes(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(size)
    return rng.normal(size=(TABLES, size + 1, HASHES)), rng.uniform(size=(TABLES, HASHES))


def _augmented(x: np.ndarray, greatest: float | None) -> np.ndarray:
    """Vectors of length 1: indexed ones if the greatest norm is given, else queries."""
    norms = np.linalg.norm(x, axis=1)
    x = x / (norms[:, None] if greatest is None else greatest)
    rest = np.zeros(len(x)) if greatest is None else np.sqrt(np.maximum(0, 1 - (norms / greatest) ** 2))
    return np.hstack([x, rest[:, None]])


def _hashed(x: np.ndarray, t: int, width: float) -> np.ndarray:
    a, b = _planes(x.shape[1] - 1)
    return x @ a[t] / width + b[t]


def _buckets(cells: np.ndarray) -> np.ndarray:
    cells = cells.astype(np.int64)
    return reduce(lambda h, j: h * 1009 + cells[..., j], range(HASHES), np.zeros(cells.shape[:-1], np.int64))


def _visits(x: np.ndarray, t: int, width: float, probes: int) -> np.ndarray:
    """For each query the buckets that it visits in a table, in order."""
    where = _hashed(x, t, width)
    cell = np.floor(where)
    inner = (where - cell)[:, None, :]
    far = np.where(_STEPS == 1, 1 - inner, np.where(_STEPS == -1, inner, 0.0))
    order = (far ** 2).sum(axis=2).argsort(axis=1, kind="stable")[:, :probes]
    return _buckets(cell[:, None, :] + _STEPS[order])


def fit(sample: np.ndarray, greatest: float) -> tuple[float, int]:
    """The least number of visits whose recall on the sample reaches FIT_RECALL; a wider bucket where no number does."""
    queries, rows = sample[:FIT_QUERIES], _augmented(sample, greatest)
    near = queries @ sample.T
    np.fill_diagonal(near, -np.inf)
    best = near.argsort(axis=1)[:, ::-1][:, :min(NEIGHBOURS, len(sample) - 1)]
    asked, width = _augmented(queries, None), 2.0 / np.sqrt(rows.shape[1]) * np.sqrt(rows.shape[1] - 1)
    while True:
        rank = np.full(best.shape, len(_STEPS))  # the first visit, over the tables, that meets a neighbour
        for t in range(TABLES):
            own, visits = _buckets(np.floor(_hashed(rows, t, width))), _visits(asked, t, width, len(_STEPS))
            meets = own[best][:, :, None] == visits[:, None, :]
            rank = np.minimum(rank, np.where(meets.any(axis=2), meets.argmax(axis=2), len(_STEPS)))
        recall = np.array([(rank < probes).mean() if rank.size else 1.0 for probes in range(1, len(_STEPS) + 1)])
        if (recall >= FIT_RECALL).any():
            return float(width), int((recall >= FIT_RECALL).argmax()) + 1
        width *= 1.25


def nearest(vectors: DataFrame, is_query, n: int = NEIGHBOURS) -> DataFrame:
    """The n nearest of each row of vectors (vec_id, embedding) for which the column is_query holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    good = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    rows = (vectors.where(F.col("vec_id").isNotNull() & F.forall("embedding", good) & F.exists("embedding", lambda e: e != 0))
            .select("vec_id", is_query.alias("asked"), F.transform("embedding", lambda e: e + F.lit(0.0).cast("float")).alias("v"))
            .withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64("v", F.lit(1))}))
    groups = stored(rows.groupBy(*KEY).agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.max("asked").alias("asked"))
                    .withColumn("size", F.size("v")))
    facts = groups.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))).alias("greatest")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], empty)
    greatest = facts["greatest"] * (1 + 1e-9)
    share = int(min(1.0, FIT_ROWS / facts["n"]) * (1 << 20))
    chosen = groups.where(F.pmod("k2", F.lit(1 << 20)) < share)
    fits = {}
    for size, in chosen.select("size").distinct().collect():  # lengths of vectors, one as a rule
        sample = chosen.where(F.col("size") == size).orderBy("k2").limit(2 * FIT_ROWS).select("v").toPandas()["v"]
        fits[size] = fit(np.stack(sample.to_list()).astype(np.float64), greatest)
    usual = max(fits.values(), key=lambda f: f[1], default=(4.0, len(_STEPS)))
    of = lambda size: fits.get(size, usual)

    def entries(asked: bool):
        def run(batches):
            for frame in batches:
                for size, part in frame.groupby("size"):
                    width, probes = of(int(size))
                    x = np.stack(part["v"].to_list()).astype(np.float64)
                    flat = part[["k1", "k2", "least", "size"]].assign(vector=[r.tobytes() for r in np.stack(part["v"].to_list()).astype("<f4")])
                    x = _augmented(x, None if asked else greatest)
                    for t in range(TABLES):
                        if asked:
                            visits = _visits(x, t, width, probes)
                            out = flat.loc[flat.index.repeat(visits.shape[1])].assign(bucket=visits.ravel())
                        else:
                            out = flat.assign(bucket=_buckets(np.floor(_hashed(x, t, width))))
                        yield out.assign(place=t)[["place", "size", "bucket", "k1", "k2", "least", "vector"]]
        return run

    schema = "place int, size int, bucket long, k1 long, k2 long, least long, vector binary"
    at = ["place", "size", "bucket"]
    index = groups.select(*KEY, "v", "least", "size").mapInPandas(entries(False), schema)
    asked = groups.where("asked").select(*KEY, "v", "least", "size").mapInPandas(entries(True), schema)
    parts = lambda df, name: df.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    grid = small(stored(parts(index, "n_rows").join(parts(asked, "n_asked"), at)), BROADCAST_BUCKETS)
    index = index.join(grid, at).select("*", F.pmod("k2", "n_rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_asked") - 1)).alias("j"))
    asked = asked.join(grid, at).select("*", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("i"), F.pmod("k2", "n_asked").cast("int").alias("j"))

    def compare(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["q1", "q2", "k1", "k2", "least", "score"]
        if asked.empty or rows.empty:
            return pd.DataFrame(columns=names)
        rows = rows.sort_values("least", kind="stable")
        a, x = (np.frombuffer(b"".join(df["vector"]), "<f4").reshape(len(df), -1).astype(np.float64) for df in (asked, rows))
        out = []
        for at in range(0, len(a), 512):
            score = a[at:at + 512] @ x.T
            order = np.argsort(-score, axis=1, kind="stable")[:, :n + 1]
            own, best = asked.iloc[at:at + 512], rows.iloc[order.ravel()]
            out.append(pd.DataFrame({"q1": own["k1"].to_numpy().repeat(order.shape[1]), "q2": own["k2"].to_numpy().repeat(order.shape[1]),
                                     "k1": best["k1"].to_numpy(), "k2": best["k2"].to_numpy(), "least": best["least"].to_numpy(),
                                     "score": np.take_along_axis(score, order, axis=1).ravel()}))
        return pd.concat(out)

    cell = [*at, "i", "j"]
    met = (asked.select(*cell, *KEY, "vector").groupBy(*cell).cogroup(index.select(*cell, *KEY, "least", "vector").groupBy(*cell))
           .applyInPandas(compare, "q1 long, q2 long, k1 long, k2 long, least long, score double"))
    query = ["q1", "q2"]
    best = (met.groupBy(*query, *KEY, "least").agg(F.max("score").alias("score"))
            .withColumn("r", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "least", *KEY))).where(F.col("r") <= n + 1))
    members = (rows.select(*KEY, "vec_id").withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy("vec_id"))).where(F.col("r") <= n + 1)
               .drop("r"))
    found = (best.join(members, KEY).groupBy(*query)
             .agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, 2 * (n + 1)).alias("found")))
    asked_by = rows.where("asked").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("vec_id").alias("query_id"))
    return (asked_by.join(found, query)
            .select("query_id", F.posexplode(F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, n)))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.minus")).alias("score")))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
