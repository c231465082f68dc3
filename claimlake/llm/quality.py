"""Quality rules as a ledger: every rule is evaluated once, its failure is one bit, and policies are masks over the bits.

`ledger` reads each text once and keeps the measurements and the bits of all rules. A policy is a named version with two masks: a
document stays if it fails none of the fatal rules and at most `most_soft` of the soft ones. Policies are applied, compared and
taken apart (`ablations`) on the ledger alone, whose texts are no longer needed; a rule's bit never changes its place.

Only DataFrame functions: a text is one row, and all its measurements are expressions of that row, so nothing is shuffled.
Windows of three words are known by a 64-bit hash within their text. A null text counts as empty: it has no words, so the rule
for short texts fails. Repeated rows and null doc_ids give rows like any other. Columns that aren't carried along are not read,
whatever their names. An empty table gives an empty ledger and no ablations.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions.text import let

from .common import table, words_of

#: What is measured of a text; all are counts.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words", "n_letters", "n_upper",
            "n_bullets", "n_ellipses")


@dataclass(frozen=True)
class Rule:
    """A rule fails where `failure`, SQL over the measurements in whole numbers, holds."""

    name: str
    failure: str


#: A rule's place is its bit, in every version of the ledger: new rules go to the end.
RULES = (
    Rule("short", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "2 * word_chars < 5 * n_words"),
    Rule("long_words", "word_chars > 12 * n_words"),
    Rule("no_letters", "4 * n_alpha_words < 3 * n_words"),
    Rule("dup_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("shouting", "2 * n_upper > n_letters"),
    Rule("bullets", "10 * n_bullets > 9 * n_lines"),
    Rule("ellipses", "10 * n_ellipses > 3 * n_lines"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}


def mask(*names: str) -> int:
    return sum(BIT[n] for n in set(names))


@dataclass(frozen=True)
class Policy:
    version: str
    fatal: int
    soft: int = 0
    most_soft: int = 0

    def keeps(self, bits: Column, without: int = 0) -> Column:
        """Whether a document with these bits stays, as if the rules in `without` did not exist."""
        soft = F.bit_count(bits.bitwiseAND(self.soft & ~without))
        return (bits.bitwiseAND(self.fatal & ~without) == 0) & (soft <= self.most_soft)


BASE = Policy("base", mask("short", "repeated_words"))
#: All rules; a text may fail one of the rules on lines, which poems, lists and tables of contents fail rightly.
STANDARD = Policy("standard-1", mask("short", "repeated_words", "symbols", "short_words", "long_words", "no_letters", "shouting"),
                  mask("dup_lines", "bullets", "ellipses"), 1)
STRICT = Policy("strict-1", mask(*BIT))
POLICIES = (BASE, STANDARD, STRICT)


#: Lines that count have a word.
_WORD, _BULLET, _ELLIPSIS = r"[^\x20\x09-\x0D]", r"^[\x20\x09-\x0D]*[-*•·]", r"(…|\.\.\.)[\x20\x09-\x0D]*\z"


def _left(text: Column, pattern: str) -> Column:
    """How many characters stay when all that match are taken away."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _repeated(words: Column) -> Column:
    """How many words lie in a window of three words that the text has twice or more.

    Windows are sorted by hash, beside their places; those that equal a neighbour are repeated. Each of their places, in
    order, covers three words, less what the next one covers too.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")))
    same = lambda w, i, x: F.coalesce(F.get(w, i)["h"] == x["h"], F.lit(False))
    twice = let(F.sort_array(windows), lambda w: F.filter(w, lambda x, i: same(w, i - 1, x) | same(w, i + 1, x)))
    places = F.sort_array(F.transform(twice, lambda x: x["at"]))
    covered = let(places, lambda p: F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - at, F.lit(3)))))
    return F.when(F.size(words) < 3, 0).otherwise(F.aggregate(covered, F.lit(0), lambda s, x: s + x))


def _measured(text: Column) -> Column:
    """A struct of the measurements; words and lines are made once and bound, as each is used several times."""
    def of_words(words: Column) -> Column:
        return F.struct(F.size(words), F.length(F.array_join(words, "")), F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))), _repeated(words))

    def of_lines(lines: Column) -> Column:
        said = [F.size(F.filter(lines, lambda x: x.rlike(p))) for p in (_BULLET, _ELLIPSIS)]  # noqa: B023
        return F.struct(F.size(lines), F.size(lines) - F.size(F.array_distinct(lines)), *said)

    def all_of(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
        by_words, by_lines = let(words_of(text), of_words), let(lines, of_lines)
        by_chars = F.struct(F.length(text) - _left(text, "[#*$%&|<>]+"), _left(text, r"\P{L}+"), _left(text, r"\P{Lu}+"))
        return F.struct(by_words.alias("w"), by_lines.alias("l"), by_chars.alias("c"))

    return let(F.coalesce(text, F.lit("")), all_of)


#: Where `_measured` holds each measurement.
_PLACES = {"n_words": "w.col1", "word_chars": "w.col2", "n_alpha_words": "w.col3", "n_repeat_words": "w.col4",
           "n_lines": "l.col1", "n_dup_lines": "l.col2", "n_bullets": "l.col3", "n_ellipses": "l.col4",
           "n_symbols": "c.col1", "n_letters": "c.col2", "n_upper": "c.col3"}


def measured(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, carry, MEASURES) of each document."""
    if clash := {"doc_id", "bits", *MEASURES} & set(carry):
        raise ValueError(f"columns that can't be carried: {sorted(clash)}")
    rows = docs.select("doc_id", *carry, _measured(F.col("text")).alias("_m"))
    return rows.select("doc_id", *carry, *[F.col(f"_m.{_PLACES[m]}").cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, carry: Sequence[str] = (), rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, carry, MEASURES, bits): bit i of `bits` is set if rule i fails."""
    if len(rules) > 63:
        raise ValueError("a ledger has 63 bits")
    bits = sum((F.when(F.expr(r.failure), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)), F.lit(0).cast("long"))
    return measured(docs, carry).withColumn("bits", bits)


def apply(rows: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """The ledger with one boolean per policy, `keeps_<version>`."""
    return rows.withColumns({f"keeps_{p.version}": p.keeps(F.col("bits")) for p in policies})


def patterns(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, bits, n): how many documents fail exactly these rules; at most 2^rules rows a group, summed before they move."""
    return rows.groupBy(*by, "bits").agg(F.count(F.lit(1)).alias("n"))


def profile(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, any_failed, all_failed): the rules that some and that all documents of a group fail, as bits."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bit_or("bits").alias("any_failed"), F.bit_and("bits").alias("all_failed"))


def ablations(rows: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES, by: Sequence[str] = ()) -> DataFrame:
    """(by, version, rule, n_docs, n_failed, n_kept, n_regained): what each rule of each policy costs.

    n_failed: documents that fail the rule; n_kept: those the policy keeps; n_regained: those it would keep in addition
    if it lacked this rule. All come from the counts of bit patterns, never from the texts or documents again.
    """
    parts = []
    for p in policies:
        for i, r in enumerate(rules):
            if (bit := 1 << i) & (p.fatal | p.soft):
                keeps, without = p.keeps(F.col("bits")), p.keeps(F.col("bits"), bit)
                parts.append(F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), (F.col("bits").bitwiseAND(bit) != 0).alias("failed"),
                                      keeps.alias("kept"), (without & ~keeps).alias("regained")))
    each = patterns(rows, by).select(*by, "n", F.explode(F.array(*parts)).alias("x"))
    count = lambda c: F.sum(F.when(F.col(f"x.{c}"), F.col("n")).otherwise(0))
    return each.groupBy(*by, F.col("x.version").alias("version"), F.col("x.rule").alias("rule")).agg(
        F.sum("n").alias("n_docs"), count("failed").alias("n_failed"), count("kept").alias("n_kept"), count("regained").alias("n_regained"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    bits = F.col("bits")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~BASE.keeps(bits)).alias("base_failed"),
                       (BASE.keeps(bits) & STANDARD.keeps(bits)).alias("kept"), "bits")
