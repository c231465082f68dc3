"""Secret scans: fixed patterns, and windows of high Shannon entropy in candidate strings.

A candidate is a run of 20 or more letters, digits and `+/=_-`. Within it, each character class (hex, base36, base64) has its
runs, over which a window slides; its counts, and the sum of c * log2(c) that gives the entropy, change by the character
that enters and the one that leaves. Windows that mix digits and letters and reach the class's bound are joined into spans.
What an allow-list pattern covers (UUIDs, dates, versions, counting sequences, stated placeholders) is suppressed, and so
is what another span covers already.

Null and empty texts give no spans and zero counts; rows with null or repeated doc_ids give a row each; other columns are
ignored, an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch_of, map_batches, table

Span = tuple[str, int, int]
BASE = ("assign", "access", "hex")
#: Name, characters, window, least entropy in bits, least digits and letters in a window.
CLASSES = (("entropy_hex", frozenset("0123456789abcdefABCDEF"), 24, 3.0, 4, 3),
           ("entropy_base36", frozenset("0123456789abcdefghijklmnopqrstuvwxyz"), 20, 3.6, 3, 4),
           ("entropy_base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"), 20, 3.8, 2, 4))
ORDER = {kind: k for k, kind in enumerate((*BASE, *(c[0] for c in CLASSES)))}
_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")
_CANDIDATE = re.compile("[A-Za-z0-9+/=_-]{20,}")
_DIGIT = re.compile("[0-9]")
_ALLOWED = re.compile("|".join((
    r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2,6}Z?)?", r"v?[0-9]+([_-][0-9]+){2,}",
    r"0123456789[A-Za-z]*", r"[A-Za-z]*(EXAMPLE|example|placeholder|changeme|xxxxxxxx)[A-Za-z0-9_-]*")))


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, in order of start."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


def _windows(text: str, begin: int, end: int, size: int, least: float, digits: int, letters: int) -> list[tuple[int, int]]:
    """Joined windows of text[begin:end] that reach the bounds."""
    counts: dict[str, int] = {}
    weight, n_digits, n_letters, joined = 0.0, 0, 0, []
    term = [0.0] + [c * math.log2(c) for c in range(1, size + 2)]  # one character enters before one leaves
    most = (math.log2(size) - least) * size
    for at in range(begin, end):
        c = text[at]
        n = counts.get(c, 0) + 1
        counts[c] = n
        weight += term[n] - term[n - 1]
        n_digits += c.isdigit()
        n_letters += c.isalpha()
        if (first := at - size) >= begin:
            c = text[first]
            n = counts[c] - 1
            counts[c] = n
            weight += term[n] - term[n + 1]
            n_digits -= c.isdigit()
            n_letters -= c.isalpha()
        if first + 1 >= begin and weight <= most + 1e-9 and n_digits >= digits and n_letters >= letters:
            if joined and joined[-1][1] >= first + 1:
                joined[-1] = (joined[-1][0], at + 1)
            else:
                joined.append((first + 1, at + 1))
    return joined


class Cover:
    """Spans by start with the furthest end so far, so that one look tells whether one of them holds a piece."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [a for a, _ in ordered]
        self.reach = list(accumulate((b for _, b in ordered), max))

    def holds(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a)
        return k > 0 and self.reach[k - 1] >= b


def entropy_spans(text: str, covered: list[Span]) -> list[Span]:
    """Spans of high entropy that neither the allow-list nor another span covers."""
    found: list[Span] = []
    known = Cover((a, b) for _, a, b in covered)
    for m in _CANDIDATE.finditer(text):
        if not _DIGIT.search(text, m.start(), m.end()) or known.holds(m.start(), m.end()):
            continue
        held = [(a.start(), a.end()) for a in _ALLOWED.finditer(text, m.start(), m.end())]
        for kind, characters, size, least, digits, letters in CLASSES:
            own, others, at = [], Cover(held), m.start()
            while at < m.end():
                end = at
                while end < m.end() and text[end] in characters:
                    end += 1
                if end - at >= size:
                    own += [s for s in _windows(text, at, end, size, least, digits, letters) if not known.holds(*s) and not others.holds(*s)]
                at = end + 1
            held += own
            found += [(kind, a, b) for a, b in own]
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id, text): counts of the fixed kinds, the hash of their list, and the list of all spans."""
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, lists = {kind: [] for kind in BASE}, [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            for kind in BASE:
                counts[kind].append(sum(s[0] == kind for s in base))
            hashes.append(hashlib.sha256(listed(base).encode()).hexdigest())
            lists.append(listed(sorted(base + entropy_spans(text or "", base), key=lambda s: (s[1], ORDER[s[0]]))))
        return batch_of(doc_id=batch.column("doc_id"), **{f"n_{kind}": pa.array(n, pa.int64()) for kind, n in counts.items()},
                        base_sha256=pa.array(hashes, pa.string()), spans=pa.array(lists, pa.string()))

    return map_batches(docs.select("doc_id", "text"), scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
