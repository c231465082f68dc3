"""Connected components of edges by contraction, as DataFrame operations only."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, stored


def components(edges: DataFrame, hashed: bool = False) -> DataFrame:
    """id and component (the least id reachable) of every id in edges (a, b), which may repeat or point to themselves.

    In every round each id goes to the first of itself and its neighbours, and the edges are drawn between what their ends
    went to, until none is left; then the steps of all rounds are followed from the last to the first. The order is that of
    the ids' hashes, so that a path of sequential ids takes few rounds; ids that are hashes stand in their own order, and a
    component's first id is its least. Where an id goes is stored before it meets the edges, so that a join on an id with
    very many edges can be split. Edges with a null end are left out; no edges give no rows.
    """
    place = F.col if hashed else F.xxhash64
    edges, left = counted(edges.where("a != b").select("a", "b").distinct())
    steps = []
    while left or not steps:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy(F.col("a").alias("id")).agg(F.min_by("b", place("b")).alias("to"))
                       .select("id", F.when(place("to") < place("id"), F.col("to")).otherwise(F.col("id")).alias("to")))
        steps.append(least)
        one, two = (least.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = edges.join(one, "a").join(two, "b").where("a_to != b_to")
        edges, left = counted(moved.select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).distinct())
    found = steps.pop()
    while steps:
        last, found = found.toDF("to", "end"), steps.pop()
        found = stored(found.join(last, "to", "left").select("id", F.coalesce("end", "to").alias("to")))
    if hashed:
        return found.withColumnRenamed("to", "component")
    return found.join(stored(found.groupBy("to").agg(F.min("id").alias("component"))), "to").select("id", "component")


def labelled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows (id, ...) with comp: the component of id, or id itself."""
    if found is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(found, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
