"""Column expressions over text. All of them stay inside the JVM."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as str.split() sees it: the Unicode class plus four control characters.
WS = r"[\s\x1c-\x1f]"
# The same characters, those that end lines first.
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BLANKS = "\t \x1f\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"

# Word shape, reference shape and citation shape.
WORD = "[a-z0-9]+|[가-힣]+"
CITATION = r"claim-\d{8}-\d{3,}"

# Texts that only bot walls serve, in order of precedence.
BOT_WALLS = ("JavaScript is not available", "Enable JavaScript and cookies to continue",
             "Attention Required! | Cloudflare", "Checking if the site connection is secure")

# Typographic characters and what they count as when quotes are compared.
FOLD_FROM = "\u2018\u2019\u201c\u201d\u2013\u2014\u2212\u2011\u00d7\u1d40\u00a0\u2800\u00b7"
FOLD_TO = "''\"\"----xT  ."
FOLD_DROP = "\u200b\ufeff"
ELLIPSIS = "\u2026"

# The quote heading and the mark of an omission inside a quote.
QUOTE_HEADING = "## 원문"
ELISION = "(...)"


def squash(col: Column) -> Column:
    """Whitespace runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(col, f"(?U){WS}+", " "))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BREAKS + BLANKS))


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col) == "", F.lit(True))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, even where ``then`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def filled(col: Column) -> Column:
    """The value, or null when it is the empty string."""
    return F.nullif(col, F.lit(""))


def literal_split(col: Column, mark: str) -> Column:
    return F.split(col, f"\\Q{mark}\\E")


def fold_text(col: Column) -> Column:
    """Typographic variants and whitespace runs made equal, for comparing a quote with its source."""
    plain = F.regexp_replace(F.translate(col, FOLD_FROM, FOLD_TO), f"(?U){WS}+", " ")
    return F.replace(F.translate(plain, FOLD_DROP, ""), F.lit(ELLIPSIS), F.lit("..."))


def words(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(f"({WORD})"), F.lit(1))


def tokenize(col: Column) -> Column:
    """Latin and digit runs whole; a Hangul run of two or more as its characters, then its pairs."""
    def spread(word: Column) -> Column:
        n = F.length(word)
        chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(word, i, F.lit(2)))
        return F.when(word.rlike("^[가-힣]{2}"), F.concat(chars, pairs)).otherwise(F.array(word))

    found = words(col)
    return F.when(col.rlike("[가-힣]"), F.flatten(F.transform(found, spread))).otherwise(found)


def normalize_key(text: Column, speaker: Column | None = None) -> Column:
    """First eight words in sorted order, so that wording with other case or punctuation meets itself."""
    found = words(text)
    key = F.when(F.size(found) > 0, F.array_join(F.array_sort(F.slice(found, 1, 8)), " ")) \
        .otherwise(F.lower(strip(text)))
    if speaker is None:
        return key
    return F.concat(key, F.coalesce(F.concat(F.lit("|"), F.lower(filled(speaker))), F.lit("")))


def slug(col: Column, default: str) -> Column:
    dashed = F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9가-힣]+", "-"), F.lit("-"))
    return F.coalesce(filled(dashed), F.lit(default))


def project_slug(col: Column) -> Column:
    """Slug of the last path part of a repository."""
    name = F.element_at(F.split(F.regexp_replace(col, "/+$", ""), "/"), -1)
    return slug(name, "project")


def source_filename(doc_id: Column, title: Column) -> Column:
    """A readable file name from the title, or the id where nothing of the title is left."""
    safe = squash(F.regexp_replace(title, r'[/\\:*?"<>|\x00-\x1f]', " "))
    name = F.substring(F.btrim(safe, F.lit(". ")), 1, 120)
    return F.concat(F.coalesce(filled(name), doc_id), F.lit(".md"))


def bot_wall(col: Column) -> Column:
    """The first bot-wall text the content holds, else null."""
    return F.coalesce(*[F.when(col.contains(m), F.lit(m)) for m in BOT_WALLS])


def clip_title(col: Column) -> Column:
    return strip(F.regexp_extract(col, r'(?md)^\s*title:\s*"?(.+?)"?\s*$', 1))


def _one_break(col: Column) -> Column:
    """Every line break as one newline."""
    for mark in ("\r\n", *BREAKS[1:]):  # searches for bytes
        col = F.replace(col, F.lit(mark), F.lit("\n"))
    return col


def blockquote(col: Column) -> Column:
    """Quote marks by two passes over the whole text; a line is no element of an array."""
    marked = F.replace(_one_break(strip(col)), F.lit("\n"), F.lit("\n> "))
    return F.when(strip(col) == "", "").otherwise(F.concat(F.lit("> "), F.regexp_replace(marked, rf"\n> [{BLANKS}]*+(?=\n|\z)", "\n>")))


def unblockquote(col: Column) -> Column:
    mark = rf"\n(?:> |[{BLANKS}]*+>[{BLANKS}]*+(?=\n|\z))"
    return strip(F.regexp_replace(F.concat(F.lit("\n"), _one_break(col)), mark, "\n"))


def extract_quote(body: Column) -> Column:
    """The text under the quote heading without its quote marks; empty where there is no such heading."""
    tail = F.get(F.split(body, "\\Q\n" + QUOTE_HEADING + "\n\\E", 2), F.lit(1))
    return F.coalesce(unblockquote(tail), F.lit(""))


def is_doc_id(col: Column, *prefixes: str) -> Column:
    return F.coalesce(col.rlike(rf"^(?:{'|'.join(prefixes)})-[0-9]{{8}}-[0-9]+\z"), F.lit(False))


def doc_id(prefix: str, date: Column, seq: Column) -> Column:
    return F.format_string(f"{prefix}-%s-%03d", F.date_format(date, "yyyyMMdd"), seq)


def cited_claims(body: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(f"({CITATION})"), F.lit(1))))


def has_written_evidence(refs: Column) -> Column:
    return F.coalesce(F.exists(refs, lambda r: ~is_blank(r)), F.lit(False))


def literal_map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def rank_of(col: Column, ordered: tuple[str, ...]) -> Column:
    """Position of a value in a closed ordered set, null outside it."""
    return literal_map({v: i for i, v in enumerate(ordered)})[col]
