"""Integrity checks over a corpus. Every check yields (check, severity, ref, message)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions import text as tx
from claimlake.operators import quotes
from claimlake.operators.intake import stem
from claimlake.operators.ledger import duplicate_groups
from claimlake.schema import ID_PREFIXES, PAGE_TYPES
from claimlake.session import cut_lineage
from claimlake.skew import skew_join, whole_groups
from claimlake.sources.sinks import status_folder

SEVERITIES = ("error", "warning", "info")
THIN_SOURCE = 200


def finding(df: DataFrame, check: str, severity: str, ref: Column, *message: Column | str) -> DataFrame:
    parts = [m if isinstance(m, Column) else F.lit(m) for m in message]
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), ref.alias("ref"),
                     F.concat(*parts).alias("message"))


def status_folder_mismatch(claims: DataFrame) -> DataFrame:
    due = status_folder(F.col("status"))
    return finding(claims.filter(due != F.col("folder")), "status_folder_mismatch", "error", F.col("id"),
                   "status ", F.col("status"), " belongs in ", due, ", found in ", F.col("folder"))


def missing_source_refs(claims: DataFrame) -> DataFrame:
    return finding(claims.filter(F.coalesce(F.size("source_refs"), F.lit(0)) == 0), "missing_source_refs", "warning",
                   F.col("id"), "no source_refs")


def verified_without_evidence(claims: DataFrame) -> DataFrame:
    bare = claims.filter((F.col("status") == "verified") & ~tx.has_written_evidence(F.col("evidence_refs")))
    return finding(bare, "verified_without_evidence", "warning", F.col("id"), "verified, but no written evidence_refs")


def duplicate_claim(claims: DataFrame) -> DataFrame:
    """One finding per group of claims with one key."""
    return finding(duplicate_groups(claims), "duplicate_claim", "warning", F.array_join("ids", ", "),
                   "same normalized key: ", F.col("n").cast("string"), " claims")


def orphan_wiki(pages: DataFrame) -> DataFrame:
    bare = pages.filter(F.col("type").isin(*PAGE_TYPES) & (F.coalesce(F.size("claim_refs"), F.lit(0)) == 0))
    return finding(bare, "orphan_wiki", "info", F.col("name"), "page without claim_refs")


def thin_source(sources: DataFrame) -> DataFrame:
    size = F.length(tx.strip(F.col("body")))
    return finding(sources.filter(size < THIN_SOURCE), "thin_source", "warning", F.coalesce(tx.filled(F.col("id")), "path"),
                   "body of ", size.cast("string"), " chars")


def quote_not_in_source(claims: DataFrame, sources: DataFrame) -> DataFrame:
    bad = quotes.quote_not_in_source(claims, sources)
    return finding(bad, "quote_not_in_source", "warning", F.col("id"), "not verbatim in ",
                   F.array_join("source_refs", ", "), "; first unmatched: ", F.col("first_missing"))


def unparseable(corpus: DataFrame) -> DataFrame:
    return finding(corpus.filter("corrupt"), "unparseable", "error", F.col("path"), "frontmatter cannot be read")


def inbox(states: DataFrame) -> DataFrame:
    """Findings from classified clips (path, state[, corrupt]); unreadable ones are reported as such elsewhere."""
    left = F.col("state") == "leftover"
    seen = states.filter(~F.coalesce("corrupt", F.lit(False))) if "corrupt" in states.columns else states
    return seen.select(F.when(left, "inbox_ingested_leftover").otherwise("inbox_unstructured").alias("check"),
                       F.lit("info").alias("severity"), F.col("path").alias("ref"),
                       F.when(left, "already inside a source").otherwise("waits for ingest").alias("message"))


def stale(records: DataFrame, as_of: str) -> DataFrame:
    """``review_after`` is compared as text, so partial dates count as they sort."""
    after = tx.filled(F.col("review_after").cast("string"))
    return finding(records.filter(after <= as_of), "stale", "warning", F.col("id"), "review_after ", after, " has passed")


def duplicate_id(files: DataFrame) -> DataFrame:
    """``files`` is (path, id). Project documents are numbered per project."""
    project = F.when(F.col("path").startswith("01_Projects/"), F.try_element_at(F.split("path", "/"), F.lit(2))).otherwise("")
    return _repeated(files.filter(tx.filled(F.col("id")).isNotNull()).select("id", project.alias("scope"), "path"))


def _repeated(named: DataFrame) -> DataFrame:
    groups = whole_groups(named, ["id", "scope"], "path", "paths", at_least=2)
    return finding(groups, "duplicate_id", "error", F.col("id"), "in several files: ", F.array_join("paths", ", "))


def references(records: DataFrame, fields=("source_refs", "evidence_refs", "claim_refs")) -> DataFrame:
    """(holder, ref), one row per occurrence."""
    have = [F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields if f in records.columns]
    return records.select(F.col("id").alias("holder"), F.explode(F.concat(*have)).alias("ref"))


def dangling_ref(refs: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` is (id). Only references that look like ids can dangle."""
    ids = known.select(F.col("id").alias("ref")).distinct()
    lost = skew_join(refs.filter(tx.is_doc_id(F.col("ref"), *ID_PREFIXES)), ids, ["ref"], "left_anti", ["holder"])
    return finding(lost, "dangling_ref", "warning", F.col("holder"), "refers to ", F.col("ref"), ", which does not exist")


def index_dangling(entries: DataFrame, files: DataFrame, index: str) -> DataFrame:
    """Index lines (id) without a file of that name among ``files`` (path)."""
    names = files.select(stem("path").alias("id")).distinct()
    return finding(entries.join(names, "id", "left_anti"), "index_dangling", "warning", F.col("id"), f"{index} entry without a file")


def all_findings(*parts: DataFrame) -> DataFrame:
    """Findings in order of severity, check, ref and message."""
    joined = reduce(DataFrame.unionByName, parts)
    return joined.orderBy(F.coalesce(tx.rank_of(F.col("severity"), SEVERITIES), F.lit(len(SEVERITIES))), "check", "ref", "message")


def summary(findings: DataFrame) -> DataFrame:
    """(findings, errors, failed)."""
    errors = F.count_if(F.col("severity") == "error")
    return findings.agg(F.count(F.lit(1)).alias("findings"), errors.alias("errors"), (errors > 0).alias("failed"))


#: Each index and the root that has a file for each of its entries.
INDEX_ROOTS = {"claim-index": "10_Claims", "learning-index": "30_Learning", "wiki-index": "03_Resources"}
ENTRY = r"^- \[([^\]]+)\]"


def _fact(kind: str, key: Column, value: Column, path: Column, note: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"), path.alias("path"), (F.lit(None).cast("string") if note is None else note).alias("note"))


def _found(check: str, severity: str, ref: Column, *message: Column | str) -> Column:
    """A finding as a fact: its check, severity, reference and message."""
    return _fact("finding", F.lit(check), F.lit(severity), ref, F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message]))


def facts(corpus: DataFrame, as_of: str) -> DataFrame:
    """(kind, key, value, path, note): all that the checks need of a record but its body, from one scan of a parsed corpus.

    What a record shows by itself is a ``finding``. The rest are narrow rows that checks across records join or group: each
    record's ``id`` with its scope, each ``ref`` with its holder, each claim's normalized key (``claim``) and ``quote``, each file's ``stem``.
    """
    from claimlake.sources.corpus import many
    text = lambda k: F.coalesce(F.col("meta")[k], F.lit(""))
    path, own = F.col("path"), F.coalesce(tx.filled(F.col("meta")["id"]), F.col("path"))
    fine, root = ~F.col("corrupt"), F.col("root")
    is_claim = fine & (root == "10_Claims") & F.substring_index("path", "/", -1).startswith("claim-")
    is_source, is_page = fine & (text("type") == "source"), fine & (root == "03_Resources")
    folder, due = F.element_at(F.split("path", "/"), -2), status_folder(text("status"))
    after = tx.filled(F.col("meta")["review_after"])
    size, quote = F.col("_size"), F.col("_quote")
    scope = F.when(path.startswith("01_Projects/"), F.try_element_at(F.split("path", "/"), F.lit(2))).otherwise("")
    usable = is_claim & tx.filled(text("id")).isNotNull()
    some = [
        F.when(~fine, _found("unparseable", "error", path, "frontmatter cannot be read")),
        F.when(is_claim & (due != folder), _found("status_folder_mismatch", "error", text("id"), "status ", text("status"), " belongs in ", due, ", found in ", folder)),
        F.when(is_claim & (F.size(many("source_refs")) == 0), _found("missing_source_refs", "warning", text("id"), "no source_refs")),
        F.when(is_claim & (text("status") == "verified") & ~tx.has_written_evidence(many("evidence_refs")),
               _found("verified_without_evidence", "warning", text("id"), "verified, but no written evidence_refs")),
        F.when(is_page & text("type").isin(*PAGE_TYPES) & (F.size(many("claim_refs")) == 0), _found("orphan_wiki", "info", text("name"), "page without claim_refs")),
        F.when(size < THIN_SOURCE, _found("thin_source", "warning", own, "body of ", size.cast("string"), " chars")),
        F.when(fine & (after <= as_of), _found("stale", "warning", own, "review_after ", after, " has passed")),
        F.when(fine & (own != path), _fact("id", own, scope, path)),
        F.when(usable, _fact("claim", tx.normalize_key(text("claim"), text("speaker")), text("id"), path)),
        F.when(~tx.is_blank(quote), _fact("quote", text("id"), quote, path, F.to_json(many("source_refs")))),
        _fact("stem", root, stem("path"), path)]
    refs = F.transform(F.concat(*[many(f) for f in ("source_refs", "evidence_refs", "claim_refs")]), lambda r: _fact("ref", own, r, path))
    rows = F.concat(F.filter(F.array(*some), lambda x: x.isNotNull()), F.when(fine, refs).otherwise(F.slice(refs, 1, 0)))
    seen = corpus.select("path", "root", "meta", "lists", "corrupt", F.when(is_source, F.length(tx.strip(F.col("body")))).alias("_size"),
                         F.when(is_claim, tx.extract_quote(F.col("body"))).alias("_quote"))  # bodies end here
    return seen.select(F.explode(rows).alias("f")).select("f.*")


def index_entries(indexes: DataFrame) -> DataFrame:
    """(index, id): the entries of index documents (path, text), read line by line."""
    lines = indexes.select(stem("path").alias("index"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("index", F.regexp_extract("line", ENTRY, 1).alias("id")).filter("id <> ''")


def _index_findings(entries: DataFrame, stems: DataFrame) -> DataFrame:
    root = tx.literal_map(INDEX_ROOTS)[F.col("index")]
    rooted = entries.withColumn("key", root).filter("key is not null")
    lost = rooted.join(stems.select("key", F.col("value").alias("id")).distinct(), ["key", "id"], "left_anti")
    return finding(lost, "index_dangling", "warning", F.col("id"), F.col("index"), " entry without a file")


def lint_corpus(corpus: DataFrame, as_of: str, indexes: DataFrame | None = None) -> DataFrame:
    """All checks over a parsed corpus scanned without roots, and over its index documents (path, text) if given.

    One scan gives the facts, which are written once; whatever spans records works on these narrow rows. Bodies are read
    again by two checks only, that of quotes (sources) and that of the inbox (clips and what was captured from their urls).
    """
    from claimlake.operators.intake import classify_inbox
    from claimlake.sources import corpus as co
    known = cut_lineage(facts(corpus, as_of))
    of = lambda kind: known.filter(F.col("kind") == kind)
    local = of("finding").select(F.col("key").alias("check"), F.col("value").alias("severity"), F.col("path").alias("ref"), F.col("note").alias("message"))
    ids = of("id").select(F.col("key").alias("id"), F.col("value").alias("scope"), "path")
    same_key = whole_groups(of("claim").select("key", F.col("value").alias("id")), ["key"], "id", "ids", at_least=2)
    quoted = of("quote").select(F.col("key").alias("id"), "path", F.from_json("note", "array<string>").alias("source_refs"), F.col("value").alias("quote"))
    meta = lambda k: tx.filled(F.col("meta")[k])
    clips = co.clips(corpus.filter(~F.col("corrupt")))
    with_url = corpus.filter(~F.col("corrupt") & (F.col("root") == "00_Inbox") & meta("id").isNotNull()).select(meta("id").alias("id"), meta("url").alias("url"), "body")
    parts = [local,
             finding(same_key, "duplicate_claim", "warning", F.array_join("ids", ", "), "same normalized key: ", F.col("n").cast("string"), " claims"),
             quote_not_in_source(quoted, co.sources_of(corpus)), inbox(classify_inbox(clips, with_url)), _repeated(ids),
             dangling_ref(of("ref").select(F.col("key").alias("holder"), F.col("value").alias("ref")), ids)]
    if indexes is not None:
        parts.append(_index_findings(index_entries(indexes), of("stem")))
    return all_findings(*parts)
