"""Rules that split rows into accepted and quarantined, and the selections built on closed value sets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions import text as tx
from claimlake.schema import SENSITIVITIES, SHARED_ROOTS
from claimlake.skew import skew_join


def outside(col: Column, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(col.isin(*allowed), F.lit(False))


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that a row breaks, else null."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``reason``)."""
    judged = df.withColumn("reason", first_reason(rules))
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def list_pending(claims: DataFrame) -> DataFrame:
    """Claims that still wait for review: unverified ones in the pending folder."""
    return (claims.filter((F.col("folder") == "pending") & (F.col("status") == "unverified") & tx.filled(F.col("id")).isNotNull())
            .select("id", "claim", "claim_type", "proposed_status").orderBy("id"))


def due_reviews(items: DataFrame, as_of: str) -> DataFrame:
    return (items.filter((F.col("next_review") <= F.lit(as_of).cast("date")) & tx.filled(F.col("id")).isNotNull())
            .select("id", F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("level", F.lit("unknown")).alias("level"))
            .orderBy("id"))


def embed_gate(docs: DataFrame, blocked: tuple[str, ...]) -> DataFrame:
    """Adds ``send``: whether the text may go to the embedding job. Without blocked values everything may."""
    if not blocked:
        return docs.withColumn("send", F.lit(True))
    barred = F.coalesce(F.col("sensitivity").isin(*blocked), F.lit(False)) | F.coalesce("pre_ingest", F.lit(False))
    return docs.withColumn("send", ~barred)


def placement_leak(records: DataFrame) -> DataFrame:
    """Records more sensitive than personal in roots that everyone reads."""
    return records.filter(F.col("root").isin(*SHARED_ROOTS) & F.col("sensitivity").isin(*SENSITIVITIES[1:]))


def source_rank(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, rank): the highest sensitivity rank among the sources a claim refers to; unknown ones do not count."""
    known = (sources.select(F.col("id").alias("ref"), F.coalesce(tx.rank_of(F.col("sensitivity"), SENSITIVITIES), F.lit(0)).alias("rank"))
             .filter("rank > 0").groupBy("ref").agg(F.max("rank").alias("rank")))
    refs = claims.select("path", F.explode("source_refs").alias("ref")).filter(tx.is_doc_id(F.col("ref"), "source"))
    return skew_join(refs, known, ["ref"], "inner", ["path"]).groupBy("path").agg(F.max("rank").alias("rank"))


def inherit_sensitivity(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with ``inherited``; a value of their own in ``explicit`` wins where the column exists."""
    names = F.array(*[F.lit(s) for s in SENSITIVITIES])
    out = claims.join(source_rank(claims, sources), "path", "left")
    derived = F.element_at(names, F.coalesce("rank", F.lit(0)) + 1)
    own = tx.filled(F.col("explicit")) if "explicit" in claims.columns else F.lit(None)
    return out.withColumn("inherited", F.coalesce(own, derived)).drop("rank")


def derived_leak(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims marked less sensitive than their most sensitive source."""
    out = inherit_sensitivity(claims.drop("explicit"), sources)
    lower = F.coalesce(tx.rank_of(F.col("sensitivity"), SENSITIVITIES), F.lit(0)) < tx.rank_of(F.col("inherited"), SENSITIVITIES)
    return out.filter(lower).select("id", "path", "sensitivity", "inherited")
