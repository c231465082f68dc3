"""What waits for whom: the state of the work and the one next step."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.functions import text as tx
from claimlake.operators.gates import due_reviews
from claimlake.operators.intake import stem
from claimlake.operators.ledger import current_claims
from claimlake.schema import CITABLE

# The waiting points; those of NEXT in the order in which they are worked off.
NEXT = ("unstructured_inbox", "ingested_leftovers", "unverified_claims", "citable_unlinked", "due_reviews")
STAGES = (*NEXT, "verified_claims", "wiki_pages", "learning_items")


def claim_statuses(claims: DataFrame) -> DataFrame:
    """(id, status) by status, whatever the folder."""
    known = claims.filter(tx.filled(F.col("id")).isNotNull() & tx.filled(F.col("status")).isNotNull())
    return current_claims(known.select("id", "status", "folder", "path")).select("id", "status")


def referenced_claims(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("claim_refs").alias("id")).distinct()


def citable_unlinked(claims: DataFrame, pages: DataFrame) -> DataFrame:
    usable = claim_statuses(claims).filter(F.col("status").isin(*CITABLE))
    return usable.join(referenced_claims(pages), "id", "left_anti").select("id")


def vault_state(inbox: DataFrame, claims: DataFrame, pages: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """(stage, id). ``inbox`` is classified clips (path, state)."""
    at = lambda df, stage, col="id": df.select(F.lit(stage).alias("stage"), F.col(col).alias("id"))
    leftover = F.col("state") == "leftover"
    clips = inbox.select(F.when(leftover, "ingested_leftovers").otherwise("unstructured_inbox").alias("stage"),
                         F.substring_index("path", "/", -1).alias("id"))
    judged = claim_statuses(claims).filter(F.col("status").isin("unverified", "verified"))
    claims_at = judged.select(F.concat("status", F.lit("_claims")).alias("stage"), "id")
    page_names = pages.select(stem("path").alias("id")) if "path" in pages.columns else pages.select(F.col("name").alias("id"))
    return (clips.unionByName(claims_at).unionByName(at(citable_unlinked(claims, pages), "citable_unlinked"))
            .unionByName(at(page_names, "wiki_pages")).unionByName(at(items, "learning_items"))
            .unionByName(at(due_reviews(items, as_of), "due_reviews")))


def stage_counts(state: DataFrame) -> DataFrame:
    """(stage, n) for every stage, zeros included."""
    per_stage = state.groupBy().agg(*[F.count_if(F.col("stage") == s).alias(s) for s in STAGES])
    pairs = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in STAGES])
    return per_stage.select(F.explode(pairs).alias("p")).select("p.stage", "p.n")


def next_step(state: DataFrame) -> DataFrame:
    """(stage, n): the first waiting point that holds anything; no row when nothing waits."""
    counts = stage_counts(state).filter(F.col("stage").isin(*NEXT) & (F.col("n") > 0))
    place = tx.rank_of(F.col("stage"), NEXT)
    first = counts.agg(F.min_by(F.struct("stage", "n"), place).alias("s"))
    return first.filter("s is not null").select("s.stage", "s.n")
