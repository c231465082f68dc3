"""Spaced repetition."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions import text as tx
from claimlake.operators.gates import first_reason
from claimlake.operators.intake import allocate_ids
from claimlake.schema import LEVELS, REVIEW_DAYS
from claimlake.skew import skew_join


def create_items(new: DataFrame, existing: DataFrame, as_of: str) -> DataFrame:
    """New items (ord, topic, skill_area, source_refs, wiki_refs): level unknown, due at once."""
    dated = new.withColumn("created", F.lit(as_of).cast("date"))
    none = F.array().cast("array<string>")
    return allocate_ids(dated, existing, "learning", "created", "ord").select(
        "id", "topic", "skill_area", F.lit(LEVELS[0]).alias("level"), F.coalesce("source_refs", none).alias("source_refs"),
        F.coalesce("wiki_refs", none).alias("wiki_refs"), "created", F.col("created").alias("next_review"), "ord")


def review_summary(reviews: DataFrame) -> DataFrame:
    """What a run of reviews does to an item, as an aggregate: passes, and the last review in ``seq`` order."""
    return reviews.groupBy("learning_id").agg(
        F.count_if("passed").alias("passes"), F.count(F.lit(1)).alias("n_reviews"),
        F.max_by(F.struct("date", "passed"), "seq").alias("last"))


def schedule(level: Column, passes: Column, last: Column) -> tuple[Column, Column]:
    """(level, next review): a pass climbs one level up to the top, a failure keeps the level and is due next day."""
    top = len(LEVELS) - 1
    start = F.coalesce(tx.rank_of(level, LEVELS), F.lit(0))
    end = F.least(start + passes, F.lit(top)).cast("int")
    before = F.least(start + passes - F.when(last["passed"], 1).otherwise(0), F.lit(top)).cast("int")
    waits = F.array(*[F.lit(d) for d in REVIEW_DAYS])
    wait = F.when(last["passed"], F.element_at(waits, F.least(before, F.lit(len(REVIEW_DAYS) - 1)) + 1)).otherwise(1)
    return F.element_at(F.array(*[F.lit(v) for v in LEVELS]), end + 1), F.date_add(last["date"], wait)


def apply_reviews(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items after their reviews. A level only ever climbs by passes, so counts and the last review are enough."""
    merged = items.join(review_summary(reviews).withColumnRenamed("learning_id", "id"), "id", "left")
    level, due = schedule(F.col("level"), F.col("passes"), F.col("last"))
    reviewed = F.col("last").isNotNull()
    return merged.withColumn("next_review", F.when(reviewed, due).otherwise(F.col("next_review"))) \
        .withColumn("level", F.when(reviewed, level).otherwise(F.col("level"))) \
        .withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0))).drop("passes", "last")


def review_rejections(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """Reviews of ids that are malformed or unknown."""
    known = items.select(F.col("id").alias("learning_id"), F.lit(True).alias("_known"))
    return skew_join(reviews, known, ["learning_id"], "left", ["seq"]).withColumn("rejection", first_reason({
        "bad id": ~tx.is_doc_id(F.col("learning_id"), "learning"), "no such item": F.col("_known").isNull()})) \
        .filter("rejection is not null").drop("_known")
