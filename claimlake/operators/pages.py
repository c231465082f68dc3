"""Wiki pages, project documents and work sessions."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlake.functions import text as tx
from claimlake.operators.gates import first_reason, outside
from claimlake.operators.intake import allocate_ids
from claimlake.schema import PAGE_FOLDER, PAGE_TYPES
from claimlake.skew import skew_join

NONE = "cast(array() as array<string>)"


def create_pages(new: DataFrame, pages: DataFrame, as_of: str, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(created, quarantine) for pages (ord, name, type, domain, aliases, sensitivity, claim_refs, body).

    Type and slug name a page. Without ``overwrite`` the first of a batch wins and stored pages stay; with it the last
    of the batch wins.
    """
    named = new.withColumn("slug", tx.slug(F.col("name"), "page")).withColumn(
        "reason", first_reason({"unknown page_type": outside(F.col("type"), PAGE_TYPES)}))
    valid = named.filter("reason is null").select("type", "slug", "ord")
    pick = F.max if overwrite else F.min
    winners = valid.groupBy("type", "slug").agg(pick("ord").alias("_winner"))
    stored = pages.select("type", tx.slug(F.col("name"), "page").alias("slug")).distinct().withColumn("_stored", F.lit(True))
    winners = winners.join(stored, ["type", "slug"], "left")
    lost = F.col("ord") != F.col("_winner")
    if not overwrite:
        lost = lost | F.col("_stored").isNotNull()
    judged = skew_join(named, winners, ["type", "slug"], "left", ["ord"]).withColumn(
        "reason", F.coalesce("reason", F.when(lost, "page exists")))
    day = F.lit(as_of).cast("date")
    created = judged.filter("reason is null").select(
        "type", "name", "slug", F.coalesce("domain", F.expr(NONE)).alias("domain"), F.coalesce("aliases", F.expr(NONE)).alias("aliases"),
        F.lit("draft").alias("status"), F.coalesce("sensitivity", F.lit("personal")).alias("sensitivity"),
        day.alias("created"), day.alias("updated"), F.coalesce("claim_refs", F.expr(NONE)).alias("claim_refs"),
        F.expr(NONE).alias("code_refs"), "body",
        F.concat(F.lit("03_Resources/"), tx.literal_map(PAGE_FOLDER)[F.col("type")], F.lit("/"), "slug", F.lit(".md")).alias("path"),
        F.concat("name", F.lit(" ("), "type", F.lit(")")).alias("index_line"))
    return created, judged.filter("reason is not null").select("ord", "name", "type", "slug", "reason")


def update_pages(pages: DataFrame, patches: DataFrame) -> DataFrame:
    """Pages after patches (name, seq, add_refs, aliases, status, body, date) in ``seq`` order per page.

    Missing refs are appended in the order they first occur; the other fields take the last value given.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
    given = patches.withColumn("status", tx.filled(F.col("status")))
    fields = given.groupBy("name").agg(last("aliases"), last("status"), last("body"), last("date"))
    refs = (given.select("name", "seq", F.posexplode("add_refs").alias("pos", "ref"))
            .groupBy("name", "ref").agg(F.min(F.struct("seq", "pos")).alias("at")))
    added = refs.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("at", "ref"))).alias("_refs"))
    out = pages.join(fields, "name", "left").join(added, "name", "left")
    fresh = F.array_except(F.coalesce(F.col("_refs.ref"), F.expr(NONE)), F.coalesce("claim_refs", F.expr(NONE)))
    return (out.withColumn("claim_refs", F.concat(F.coalesce("claim_refs", F.expr(NONE)), fresh))
            .withColumn("aliases", F.coalesce("_aliases", "aliases")).withColumn("status", F.coalesce("_status", "status"))
            .withColumn("body", F.coalesce("_body", "body")).withColumn("updated", F.coalesce("_date", "updated"))
            .select(*pages.columns))


def create_project_docs(new: DataFrame, existing: DataFrame, kind: str, as_of: str) -> DataFrame:
    """Sessions (repo, title, body) or decisions (repo, title, context, decision, alternatives, consequences) with ``ord``.

    Numbers run per project: ``existing`` is (repo, id) of the documents there are.
    """
    slugged = new.withColumn("repo", tx.project_slug(F.col("repo"))).withColumn("created", F.lit(as_of).cast("date"))
    numbered = allocate_ids(slugged, existing.withColumn("repo", tx.project_slug(F.col("repo"))), kind, "created", "ord", scope="repo")
    sections = [F.lit(f"## {name.capitalize()}\n\n") for name in ("context", "decision", "alternatives", "consequences")]
    if kind == "decision":
        texts = [F.concat(h, F.coalesce(c, F.lit(""))) for h, c in zip(sections, ("context", "decision", "alternatives", "consequences"))]
        body, status = F.concat(F.array_join(F.array(*texts), "\n\n"), F.lit("\n")), F.lit("accepted")
    else:
        body, status = F.col("body"), F.lit(None).cast("string")
    return numbered.select("id", F.lit(kind).alias("type"), "repo", "title", status.alias("status"),
                           F.lit("work").alias("sensitivity"), "created", body.alias("body"), "ord")


def session_rollup(entries: DataFrame, limit: int = 20000, separator: str = "\n") -> DataFrame:
    """(session, n_entries, total_chars, text): entries in ``turn`` order as one text, cut at ``limit`` with a note.

    Sizes are sums over all entries. Every entry but the first brings a separator, so the text that is shown lies in the
    first ``limit`` + 1 entries; a limited window drops the others before the shuffle, and no task sees more than that.
    """
    sizes = entries.groupBy("session").agg(F.count(F.lit(1)).alias("n_entries"), F.sum(F.length("text")).alias("_chars"))
    order = Window.partitionBy("session").orderBy("turn")
    shown = (entries.select("session", "turn", F.substring("text", 1, limit + 1).alias("text"), F.length("text").alias("_len"))
             .withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit + 1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce(F.sum(F.col("_len") + len(separator)).over(before), F.lit(0))
    shown = shown.withColumn("_at", starts).filter(F.col("_at") <= limit)
    texts = shown.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_parts"))
    total = F.col("_chars") + (F.col("n_entries") - 1) * len(separator)
    text = F.substring(F.array_join(F.col("_parts.text"), separator), 1, limit)
    note = F.concat(F.lit(f"\n[truncated: showing {limit} of "), F.col("total_chars").cast("string"), F.lit(" chars]"))
    return sizes.join(texts, "session").withColumn("total_chars", total).select(
        "session", "n_entries", "total_chars", F.concat(text, F.when(F.col("total_chars") > limit, note).otherwise("")).alias("text"))


def session_entries(entries: DataFrame) -> DataFrame:
    """The complete list that goes with a rollup, one row per entry: what a cut text may not show."""
    return entries.select("session", "turn", F.substring_index("text", "\n", 1).alias("subject"))


def body_refs(pages: DataFrame) -> DataFrame:
    return pages.select("name", tx.cited_claims(F.col("body")).alias("refs"))


def ref_mismatch(pages: DataFrame) -> DataFrame:
    """Pages whose list of claims and whose body disagree, with what each side lacks."""
    cited = tx.cited_claims(F.col("body"))
    out = pages.select("name", F.array_sort(F.array_except(cited, "claim_refs")).alias("only_body"),
                       F.array_sort(F.array_except("claim_refs", cited)).alias("only_refs"))
    return out.filter("size(only_body) > 0 or size(only_refs) > 0")


def reference_edges(**holders: tuple[DataFrame, str, list[str]]) -> DataFrame:
    """(holder, field, target) from tables given as name=(frame, id column, list columns)."""
    parts = [df.select(F.col(key).alias("holder"), F.lit(field).alias("field"), F.explode(field).alias("target"))
             for df, key, fields in holders.values() for field in fields]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def one_hop(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref): hits and the documents one reference away from them, in either direction."""
    found = hits.select("ref").distinct()
    at = lambda side, other: skew_join(edges, found.withColumnRenamed("ref", side), [side], "left_semi", [other])
    out = at("holder", "target").select(F.col("target").alias("ref"))
    back = at("target", "holder").select(F.col("holder").alias("ref"))
    return found.unionByName(out).unionByName(back).distinct()
