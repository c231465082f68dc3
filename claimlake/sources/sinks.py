"""Logs, indexes, partitioned ledgers and rendered documents."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions import text as tx
from claimlake.schema import PAGE_FOLDER, STATUS_FOLDER
from claimlake.skew import latest_per_key


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_spread(spark: SparkSession, path: str, key: str, small: int = 256 << 20) -> DataFrame:
    """A table of long texts. A small file is one row group and would be worked on by one task, so it is spread over the
    cores by ``key``; a table beyond ``small`` bytes has parts enough and is read as it lies.
    """
    df = spark.read.parquet(path)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism, key) if size < small else df


def append_log(lines: DataFrame, path: str) -> None:
    """(ts, line) rows added to a log that is never rewritten."""
    (lines.select("ts", F.concat(F.lit("- "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" - "), F.col("line"))
                  .alias("value"), F.to_date("ts").alias("day"))
     .write.mode("append").partitionBy("day").parquet(path))


def upsert_latest(entries: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """One line per key, the newest, on a single line of text."""
    newest = latest_per_key(entries, [key], F.col(order))
    return newest.withColumn("line", tx.squash(F.col("line")))


def status_folder(status: Column) -> Column:
    return tx.literal_map(STATUS_FOLDER)[status]


def with_ledger_folder(df: DataFrame, kind: str) -> DataFrame:
    """The partition a record is kept in: by status, by page type or by project."""
    folder = {"claims": lambda: status_folder(F.col("status")),
              "pages": lambda: tx.literal_map(PAGE_FOLDER)[F.col("type")],
              "project_docs": lambda: tx.project_slug(F.col("repo"))}[kind]()
    return df.withColumn("folder", folder)


def write_ledger(df: DataFrame, path: str, kind: str) -> None:
    """Replaces the folders that ``df`` has rows for and leaves the others."""
    (with_ledger_folder(df, kind).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("folder").parquet(path))


def _scalar(key: str, col: Column) -> Column:
    """One frontmatter line. Text that YAML could read as something else is quoted as a JSON string."""
    text = col.cast("string")
    plain = text.rlike(r"^[A-Za-z][A-Za-z0-9_./-]*\z") & ~F.lower(text).isin(
        "null", "true", "false", "yes", "no", "on", "off", "y", "n")
    return F.concat(F.lit(f"{key}: "), F.when(F.coalesce(plain, F.lit(False)), text)
                    .otherwise(_json_string(F.coalesce(text, F.lit("")))))


def _json_string(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":|\}\z', "")


def _list(key: str, col: Column) -> Column:
    items = F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), _json_string(x)))
    return F.when(F.coalesce(F.size(col), F.lit(0)) == 0, F.lit(f"{key}: []")) \
        .otherwise(F.concat(F.lit(f"{key}:\n"), F.array_join(items, "\n")))


def render(df: DataFrame, path: Column, body: Column, scalars: dict[str, Column], lists: dict[str, Column]) -> DataFrame:
    """(path, text): frontmatter between fences, a blank line, the body and one final newline."""
    lines = [_scalar(k, c) for k, c in scalars.items()] + [_list(k, c) for k, c in lists.items()]
    tail = F.regexp_replace(body, f"(?U){tx.WS}+\\z", "")
    return df.select(path.alias("path"), F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"),
                                                  tail, F.lit("\n")).alias("text"))


def claim_body(claim: Column, quote: Column) -> Column:
    quoted = F.concat(F.lit(f"\n{tx.QUOTE_HEADING}\n\n"), tx.blockquote(quote), F.lit("\n"))
    return F.concat(F.lit("## Claim\n\n"), claim, F.lit("\n"), F.when(tx.is_blank(quote), "").otherwise(quoted))


def render_claims(claims: DataFrame) -> DataFrame:
    keys = ("id", "claim_type", "status", "proposed_status", "claim", "speaker", "sensitivity")
    return render(claims, F.col("path"), claim_body(F.col("claim"), F.col("quote")),
                  {"type": F.lit("claim"), **{k: F.col(k) for k in keys}},
                  {"source_refs": F.col("source_refs"), "evidence_refs": F.col("evidence_refs")})


def render_sources(sources: DataFrame) -> DataFrame:
    keys = ("id", "origin", "captured_at", "sensitivity", "url")
    return render(sources, F.col("path"), F.col("body"),
                  {"type": F.lit("source"), **{k: F.col(k) for k in keys}}, {})


def write_documents(rendered: DataFrame, path: str) -> None:
    """Rendered documents as a text table; ``path`` inside each row says which document it is."""
    rendered.write.mode("overwrite").parquet(path)
