"""Quotes against their sources: exact, folded and elided."""
from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlake.functions import text as tx
from claimlake.schema import CLAIM_TYPES
from claimlake.skew import chunked_groups, latest_per_key, skew_join

SHORT_QUOTE = 40

# Number words of English and the digits they stand for.
NUMBER_WORDS = {
    "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "ten": "10", "eleven": "11", "twelve": "12", "twenty": "20", "thirty": "30", "fifty": "50", "hundred": "100",
    "thousand": "1000", "million": "1000000", "half": "2", "twice": "2", "double": "2",
}


def current_bodies(sources: DataFrame, body: Column, name: str) -> DataFrame:
    """(ref, name): one text per source id."""
    rows = sources.filter(tx.filled(F.col("id")).isNotNull()).select(F.col("id").alias("ref"), "path", body.alias(name))
    return latest_per_key(rows, ["ref"], F.col("path")).select("ref", name)


def raw_text(body: Column) -> Column:
    return F.regexp_replace(body, r"^## Raw\n*", "")


def pieces(quote: Column) -> Column:
    """The parts of a quote between omission marks, folded, without empty ones."""
    folded = F.transform(tx.literal_split(quote, tx.ELISION), tx.squash)
    return F.filter(folded, lambda p: p != "")


def missing_pieces(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, refs_found, missing) for claims with a quote and at least one source that exists.

    A piece counts as found in the referenced bodies joined by spaces, in the order of the references. Each (claim,
    source) pair tests its own body at the join and keeps, for claims with several references, only the ends of the body
    as long as the longest piece: what spans two bodies must touch their ends. Bodies are never grouped or shuffled a
    second time.
    """
    quoted = claims.filter(~tx.is_blank(F.col("quote"))).select("path", "source_refs", pieces(F.col("quote")).alias("pieces"))
    refs = quoted.select("path", "pieces", F.size("source_refs").alias("n_refs"), F.posexplode("source_refs").alias("pos", "ref"))
    bodies = current_bodies(sources, tx.squash(F.col("body")), "hay")
    pair = skew_join(refs, bodies, ["ref"], "inner", ["path", "pos"])
    longest = F.aggregate("pieces", F.lit(0), lambda a, p: F.greatest(a, F.length(p)))
    hay, n = F.col("hay"), F.col("longest")
    # a line feed cannot occur in folded text, so it keeps the two ends apart
    ends = F.when(F.length(hay) <= 2 * n, hay).otherwise(F.concat(F.left(hay, n), F.lit("\n"), F.right(hay, n)))
    pair = pair.withColumn("longest", longest).select(
        "path", "pieces", "pos", F.transform("pieces", lambda p: hay.contains(p)).alias("here"),
        F.when(F.col("n_refs") > 1, ends).otherwise("").alias("ends"))
    grouped = pair.groupBy("path").agg(F.first("pieces").alias("pieces"), F.count(F.lit(1)).alias("refs_found"),
                                       F.sort_array(F.collect_list(F.struct("pos", "here", "ends"))).alias("tests"))
    joined = F.array_join(F.col("tests.ends"), " ")

    def absent(piece: Column, i: Column) -> Column:
        direct = F.exists("tests", lambda t: F.get(t["here"], i))
        return ~direct & ~((F.col("refs_found") > 1) & joined.contains(piece))

    return grouped.select("path", "refs_found", F.filter("pieces", absent).alias("missing"))


def quote_not_in_source(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, path, source_refs, first_missing): quotes with a piece that is in none of the claim's sources."""
    bad = missing_pieces(claims, sources).filter("size(missing) > 0")
    return claims.select("id", "path", "source_refs").join(bad, "path").select(
        "id", "path", "source_refs", F.substring(F.element_at("missing", 1), 1, 60).alias("first_missing"))


def _slices(bodies: pd.Series, quotes: pd.Series) -> pd.Series:
    """The stretch of each body that reads like its quote once both are folded."""
    table = {**dict(zip(tx.FOLD_FROM, tx.FOLD_TO)), **dict.fromkeys(tx.FOLD_DROP, ""), tx.ELLIPSIS: "..."}
    gap = "[\\s\u2800]"
    odd = re.compile(f"{gap}{{2,}}|(?! ){gap}|[{re.escape(''.join(table))}]")

    def fold(text: str) -> tuple[str, list[int], list[tuple[int, int, int]]]:
        """Folded text, and the stretches of it that are not plain: their starts, and (length, first, end in the text)."""
        pieces, starts, spans, size, end = [], [], [], 0, 0
        for found in odd.finditer(text):
            first, after = found.span()
            shown = table.get(found.group(), " ")
            size += first - end
            pieces += [text[end:first], shown]
            starts.append(size)
            spans.append((len(shown), first, after))
            size, end = size + len(shown), after
        return "".join(pieces) + text[end:], starts, spans

    def cut(body: str | None, quote: str | None) -> str | None:
        if body is None or quote is None:
            return None
        folded, starts, spans = fold(body)
        want = fold(quote)[0]
        at = folded.find(want)
        if not want or at < 0:
            return None

        def place(i: int) -> int:
            k = bisect_right(starts, i) - 1
            if k < 0:
                return i
            length, first, after = spans[k]
            return first if i < starts[k] + length else after + i - starts[k] - length

        return body[place(at):place(at + len(want) - 1) + 1]

    return pd.Series([cut(b, q) for b, q in zip(bodies, quotes)], dtype=object)


def check_quotes(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates (key, source_id, quote) with ``status`` EXACT, FIXED, NOTFOUND or null for an unknown source.

    ``fixed`` is the source's own wording for FIXED ones. Only those rows carry a body to Python.
    """
    bodies = current_bodies(sources, raw_text(F.col("body")), "raw").withColumnRenamed("ref", "source_id")
    pair = skew_join(candidates.select("key", "source_id", "quote"), bodies, ["source_id"], "left", ["key"])
    raw, quote = F.col("raw"), F.col("quote")
    folded = tx.fold_text(raw).contains(tx.fold_text(quote))
    status = (F.when(raw.isNull(), None).when(raw.contains(quote), "EXACT").when(folded, "FIXED").otherwise("NOTFOUND"))
    judged = pair.withColumn("status", status)
    cut = F.pandas_udf(_slices, "string")
    need = F.col("status") == "FIXED"
    return judged.withColumn("fixed", cut(F.when(need, raw), F.when(need, quote))).drop("raw")


def applied_quotes(checked: DataFrame) -> DataFrame:
    """Candidates with the source's wording written back."""
    return checked.select("key", "source_id", F.coalesce("fixed", "quote").alias("quote"))


def quote_audit(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, path, verdict, short) of each claim against its first source."""
    bodies = current_bodies(sources, raw_text(F.col("body")), "raw")
    first = claims.select("id", "path", tx.strip(F.coalesce("quote", F.lit(""))).alias("quote"),
                          F.try_element_at("source_refs", F.lit(1)).alias("ref"))
    pair = skew_join(first, bodies, ["ref"], "left", ["path"])
    parts = F.filter(F.transform(tx.literal_split(F.col("quote"), tx.ELISION), tx.strip), lambda p: p != "")
    raw = F.col("raw")
    exact = F.forall(parts, lambda p: raw.contains(p))
    folded = F.forall(parts, lambda p: tx.fold_text(raw).contains(tx.fold_text(p)))
    verdict = (F.when(F.col("quote") == "", "no quote").when(raw.isNull(), "source missing").when(exact, "exact")
               .when(folded, "equal after folding").otherwise("not found"))
    short = (F.col("quote") != "") & (F.length("quote") < SHORT_QUOTE)
    return pair.select("id", "path", verdict.alias("verdict"), short.alias("short"))


def audit_counts(claims: DataFrame) -> DataFrame:
    """(metric, key, n): totals, distributions and ids that lack something, in one pass with one aggregate."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    row = lambda metric, key: F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"))
    lacking = lambda metric, when: F.when(when, row(metric, F.col("id")))
    source = F.coalesce(F.try_element_at("source_refs", F.lit(1)), F.lit("?"))
    counted = F.array(
        row("total", F.lit("")), row("status", F.col("status")), row("claim_type", F.col("claim_type")),
        row("proposed_status", F.col("proposed_status")), row("source", source),
        lacking("no_evidence", empty("evidence_refs")), lacking("no_sources", empty("source_refs")),
        lacking("no_proposal", tx.filled(F.col("proposed_status")).isNull()),
        lacking("bad_type", ~F.coalesce(F.col("claim_type").isin(*CLAIM_TYPES), F.lit(False))))
    return (claims.select(F.explode(F.array_compact(counted)).alias("c")).groupBy("c.metric", "c.key")
            .agg(F.count(F.lit(1)).alias("n")))


def _bare_numbers(col: Column) -> Column:
    return F.regexp_replace(col, r"(?<=[0-9]),(?=[0-9])", "")


def review_marks(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per (claim, source it refers to) with ``marks``: array of (mark, detail) that a reviewer should see."""
    bodies = current_bodies(sources, tx.squash(F.col("body")), "hay")
    refs = claims.select("*", F.explode(F.array_distinct("source_refs")).alias("ref"))
    pair = skew_join(refs, bodies, ["ref"], "inner", ["path"])
    quote, hay = F.col("quote"), F.col("hay")
    folded = tx.squash(quote)
    absent = F.filter(pieces(quote), lambda p: ~hay.contains(p))

    def said(text: Column) -> Column:
        spelled = [F.when(text.rlike(rf"(?iU)\b{w}\b"), F.lit(" " + d)).otherwise("") for w, d in NUMBER_WORDS.items()]
        return F.concat(_bare_numbers(text), *spelled)

    numbers = F.regexp_extract_all(_bare_numbers(tx.squash(F.col("claim"))), F.lit(r"([0-9]+(?:[.,][0-9]+)*)"), F.lit(1))
    unread = tx.let(tx.let(folded, said), lambda s: F.array_distinct(F.filter(numbers, lambda t: ~s.contains(t))))
    mark = lambda name, detail: F.struct(F.lit(name).alias("mark"), detail.alias("detail"))
    unnamed = F.col("proposed_status").isin("attributed", "opinion") & tx.filled(F.col("speaker")).isNull()
    found = F.array_compact(F.array(
        F.when(F.size(absent) > 0, mark("not in source", F.substring(F.element_at(absent, 1), 1, 80))),
        F.when(F.length(folded) < SHORT_QUOTE, mark("short quote", F.length(folded).cast("string"))),
        F.when(F.size(unread) > 0, mark("numbers not in quote", F.array_join(unread, ", "))),
        F.when(unnamed, mark("no speaker", F.lit("")))))
    marks = F.when(tx.is_blank(quote), F.array(mark("no quote", F.lit("")))).otherwise(found)
    return pair.select(F.col("ref").alias("source_id"), "id", "path", "claim", "quote", "claim_type", "proposed_status",
                       "speaker", "status", marks.alias("marks"))


def review_json(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, n_claims, flagged, chunk, doc): review documents per source as JSON.

    A source with many claims gets several documents, each with its share of the claims.
    """
    rows = review_marks(claims, sources)
    fields = ("id", "claim", "quote", "claim_type", "proposed_status", "speaker", "status", "marks")
    listed = rows.withColumn("row", F.struct(*fields))
    flags = rows.groupBy("source_id").agg(F.count_if(F.size("marks") > 0).alias("flagged"))
    head = sources.select(F.col("id").alias("source_id"), "url", "origin", F.col("captured_at").cast("string").alias("captured_at"),
                          F.coalesce(tx.filled(tx.clip_title(F.col("body"))), "id").alias("title"), "path")
    head = latest_per_key(head, ["source_id"], F.col("path")).drop("path")
    docs = chunked_groups(listed, ["source_id"], "row", "claims", spread="path").join(flags, "source_id").join(head, "source_id")
    source = F.struct(F.col("source_id").alias("id"), "url", "origin", "captured_at", "title")
    return docs.select("source_id", F.col("n").alias("n_claims"), "flagged", "chunk",
                       F.to_json(F.struct(source.alias("source"), "claims", "flagged")).alias("doc"))


def review_packet(claims: DataFrame, selector: str) -> DataFrame:
    """(id, text): claim and quote pairs by id prefix or ``source:<id>``, plus a header row with id '' and the count."""
    if selector.startswith("source:"):
        chosen = claims.filter(F.array_contains("source_refs", selector.removeprefix("source:")))
    else:
        chosen = claims.filter(F.col("id").startswith(selector))
    text = F.concat(F.lit("## "), "id", F.lit("  ["), "claim_type", F.lit("] proposed="), "proposed_status", F.lit(" source="),
                    F.array_join("source_refs", ","), F.lit("\n\n### claim\n"), "claim", F.lit("\n\n### quote\n"),
                    tx.strip(F.col("quote")), F.lit("\n"))
    header = chosen.agg(F.concat(F.lit("# "), F.count(F.lit(1)), F.lit(" claims\n")).alias("text")).select(F.lit("").alias("id"), "text")
    return chosen.select("id", text.alias("text")).unionByName(header).orderBy("id")
