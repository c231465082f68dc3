"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to other tokens.

The nodes of a document's field are the spans of the fixed patterns, whose labels are known, and the tokens outside of them
that hold a digit or an at-sign; short number tokens, a blank apart, are one node. Neighbouring nodes share a chain potential.
A node has keys that repeats and similar tokens have too: an address in lower case, and up to the first dot of its domain; a
number's last seven digits, and from 13 digits on all before them, so that one changed digit leaves a key. All nodes
of a key share skip potentials with one hub, one hop from each other however far apart. A hub with members that a pattern
covers is observed: it has their labels. Loopy sum-product messages, until none changes by more than TOLERANCE, or for MOST_ROUNDS
rounds where a field doesn't settle, give each node's chances. Free nodes whose chance of a label reaches SURE become spans.

Weights are learned by pseudo-likelihood from about LEARN_FROM documents and LEARN_NODES nodes of each, chosen by hash. The patterns
read only what is written in full, so what a repeat lacks (a plus, blanks, a top-level domain) must not count against
it: a free node that shares a key is judged by coarse features, and learned from by mentions with hidden cues. Each covered
node gives one more row, with coarse features only and its own label at the hub, as a repeat of it would stand. Free nodes that share a
key with a covered one are latent and give none. Rows with hidden cues weigh as much in all as the other rows of coarse features.

Null and empty texts give no spans and zero counts; rows with null or repeated doc_ids give a row each; other columns are
ignored, an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, map_batches, table

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
#: Documents learned from, about; nodes of one of them; chance from which a token becomes a span.
LEARN_FROM, LEARN_NODES, SURE = 2_000, 2_000, 0.9
#: Change of a message below which it is settled, and rounds after which a field that doesn't settle is read as it stands.
TOLERANCE, MOST_ROUNDS = 1e-4, 1_000
#: Features of nodes on their own, and coarse ones of free nodes that share a key.
SHAPES, COARSE = 41, 4
FEATURES = SHAPES + COARSE
#: Digits of a number's key, and of one long enough for a second key.
KEY_DIGITS, LONG_NUMBER, MOST_DIGITS = 7, 13, 19
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9+][0-9\x20.()+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARKED = re.compile("[0-9@]")
_PLAIN = re.compile("[0-9+().-]+")
_NOT_DIGITS = re.compile("[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        free = at + 1
        if local and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", at - local, m.end()))
            free = m.end()
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by kind and start."""
    ips, cards, phones = [], [], []
    for run in _NUMBERS.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        own = run.group()
        if own.count(".") >= 3:
            ips += [("ip", *m.span()) for m in _IP.finditer(text, a, b) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        if b - a >= 13:
            for m in _CARD.finditer(text, a, b):
                digits = _NOT_DIGITS.sub("", m.group())
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    cards.append(("card", *m.span()))
        if "+" in own:
            phones += [("phone", *m.span()) for m in _PHONE.finditer(text, a, b) if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]
    return _emails(text) + ips + cards + phones


class Field:
    """Nodes, their features and known labels, and the pairs that share potentials: chain (node, node) and skip (node, hub)."""

    def __init__(self, text: str, base: list[Span]):
        nodes = sorted({(a, b): KINDS.index(kind) + 1 for kind, a, b in reversed(base)}.items())
        nodes += [(s, 0) for s in _free(text, [s for s, _ in nodes])]
        nodes.sort()
        self.spans = [s for s, _ in nodes]
        self.known = np.array([label for _, label in nodes], np.int64)
        self.chain = np.array([(k - 1, k) for k in range(1, len(nodes)) if nodes[k][0][0] - nodes[k - 1][0][1] <= 3], np.int64).reshape(-1, 2)
        members: dict[str, list[int]] = {}
        for k, (a, b) in enumerate(self.spans):
            for key in _keys(text[a:b]):
                members.setdefault(key, []).append(k)
        shared = [m for m in members.values() if len(m) > 1]
        self.skip = np.array([(k, hub) for hub, m in enumerate(shared) for k in m], np.int64).reshape(-1, 2)
        #: Of each hub, how many of its members have each label.
        self.hubs = np.zeros((len(shared), LABELS))
        np.add.at(self.hubs, (self.skip[:, 1], self.known[self.skip[:, 0]]), 1)
        self.hubs[:, 0] = 0
        self.linked = np.zeros(len(nodes), bool)
        self.linked[self.skip[:, 0]] = True
        self.features = np.zeros((len(nodes), FEATURES), bool)
        for k, (a, b) in enumerate(self.spans):
            if self.linked[k] and not self.known[k]:
                self.features[k, SHAPES:] = _coarse(text[a:b])
            else:
                self.features[k, :SHAPES] = _features(text, a, b, text[a:b], _NOT_DIGITS.sub("", text[a:b]))


def _free(text: str, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens that touch no covered span; short numbers, a blank apart, as one."""
    found: list[tuple[int, int]] = []
    joined, next_ = 0, 0
    reach = 0
    for a, b in _tokens(text):
        while next_ < len(covered) and covered[next_][0] < b:
            reach = max(reach, covered[next_][1])
            next_ += 1
        if reach > a:
            joined = 0
            continue
        digits = sum(c.isdigit() for c in text[a:b]) if _PLAIN.fullmatch(text, a, b) else 0
        if joined and digits and joined + digits <= MOST_DIGITS and text[found[-1][1]:a] in (" ", ")", ") "):
            found[-1] = (found[-1][0], b)
            joined += digits
        else:
            found.append((a, b))
            joined = digits
    return found


def _keys(token: str) -> set[str]:
    """What repeats of a token, and tokens similar to it, have in common with it."""
    if "@" in token:
        low = token.lower()
        name, _, domain = low.partition("@")
        return {low, f"{name}@{domain.split('.')[0]}"} if name and domain else set()
    digits = _NOT_DIGITS.sub("", token)
    if token.count(".") >= 3:
        return {token}
    if len(digits) < KEY_DIGITS or not _PLAIN.fullmatch(token.replace(" ", "")):
        return set()
    keys = {f"…{digits[-KEY_DIGITS:]}"}
    return keys | {f"{len(digits)}:{digits[:-KEY_DIGITS]}…"} if len(digits) >= LONG_NUMBER else keys


def _coarse(token: str) -> np.ndarray:
    """Features that a repeat has as well."""
    return np.array([True, "@" in token, token.count(".") >= 3, "@" not in token and any(c.isalpha() for c in token)])


def _tokens(text: str) -> list[tuple[int, int]]:
    """Runs without blanks that hold a digit or an at-sign, without brackets and stops around them."""
    found = []
    for m in _MARKED.finditer(text):
        at = m.start()
        if found and at < found[-1][1]:
            continue
        low = found[-1][1] if found else 0
        a = at
        while a > low and not text[a - 1].isspace() and text[a - 1] not in ",;:!?\"'<>[]":
            a -= 1
        b = at + 1
        while b < len(text) and not text[b].isspace() and text[b] not in ",;!?\"'<>[]":
            b += 1
        while b > at + 1 and text[b - 1] in ".)":
            b -= 1
        found.append((a, b))
    return found


def _features(text: str, a: int, b: int, token: str, digits: str) -> np.ndarray:
    out = np.zeros(SHAPES, bool)
    out[0] = True
    out[1], out[2], out[3], out[4] = "@" in token, token[0] == "+", "-" in token, "(" in token
    out[5 + min(token.count("."), 4)] = True
    n = len(digits)
    out[10 + sum(n >= x for x in (1, 3, 4, 5, 7, 9, 13, 17))] = True
    out[19], out[20] = n == len(token), any(c.isalpha() for c in token)
    out[21 + min(len(token) // 4, 6)] = True
    before = text[max(0, a - 24):a].rstrip()[-12:]
    out[28], out[29], out[30] = before.endswith((":", "=")), before[-1:].isdigit(), before[-1:].isalpha()
    after = text[b:b + 3].lstrip()
    out[31], out[32] = after[:1].isdigit(), after[:1].isalpha()
    out[33] = token.count(".") == 3 and n == len(token) - 3
    out[34] = 13 <= n <= 19
    out[35] = 9 <= n <= 15
    out[36] = "@" in token and "." in token[token.find("@"):]
    out[37] = n == 4 and n == len(token)
    out[38], out[39] = text[a - 1:a] == "+", text[a - 1:a] == "("
    out[40] = 13 <= n <= 19 and _luhn(digits)
    return out


Weights = tuple[np.ndarray, np.ndarray, np.ndarray]  # features x labels, chain potentials, skip potentials (hub x node)


def rows_of(field: Field, seed: int, most: int = LEARN_NODES) -> list[list[int]]:
    """What is learned from a field: [group, label, features and labels around that hold]; group 1 has hidden cues, 2 the other coarse rows, 0 the rest."""
    latent = np.zeros(len(field.spans), bool)
    latent[field.skip[field.hubs.sum(axis=1)[field.skip[:, 1]] > 0, 0]] = True
    latent &= field.known == 0
    beside = np.zeros((len(field.spans), LABELS), bool)
    for a, b in ((0, 1), (1, 0)):
        pairs = field.chain[~latent[field.chain[:, b]]]
        beside[pairs[:, a], field.known[pairs[:, b]]] = True
    chosen = np.arange(len(field.spans))
    if len(chosen) > most:
        chosen = np.sort(np.random.default_rng(seed).choice(chosen, most, replace=False))
    rows = []
    for k in chosen[~latent[chosen]].tolist():
        label, chain = int(field.known[k]), (FEATURES + np.flatnonzero(beside[k])).tolist()
        coarse = bool(field.linked[k]) and not label
        hub = [FEATURES + LABELS] if coarse else []
        rows.append([2 if coarse else 0, label, *np.flatnonzero(field.features[k]).tolist(), *chain, *hub])
        if label:
            hidden = [SHAPES, *([SHAPES + 1] if KINDS[label - 1] == "email" else [SHAPES + 2] if KINDS[label - 1] == "ip" else [])]
            rows.append([1, label, *hidden, *chain, FEATURES + LABELS + label])
    return rows


def learn(docs: DataFrame, learn_from: int = LEARN_FROM) -> Weights:
    """Weights by pseudo-likelihood: each node's label given its features, its neighbours' labels and its hub's."""
    share = int(min(1.0, learn_from / max(1, docs.count())) * (1 << 20))

    def nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            rows += rows_of(Field(text or "", base_spans(text or "")), zlib.crc32((text or "").encode("utf-8", "replace")))
        return batch_of(row=pa.array(rows, pa.list_(pa.int32())))

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1 << 20)) < share).select("text")
    counted = map_batches(sample, nodes, "row array<int>").groupBy("row").count().toPandas()
    return fit([list(r) for r in counted["row"]], counted["count"].to_numpy(float))


def fit(rows: list[list[int]], many: np.ndarray) -> Weights:
    """Weights of rows that occurred so many times. Skip potentials have an agreement that all labels share, so that one seen in few repeats, or none, is carried too."""
    order = sorted(range(len(rows)), key=rows.__getitem__)  # the same sums whatever the partitioning
    rows, many = [rows[k] for k in order], many[order]
    x = np.zeros((len(rows), FEATURES + 2 * LABELS))
    y = np.zeros((len(rows), LABELS))
    group = np.array([r[0] for r in rows], np.int64)
    for k, row in enumerate(rows):
        x[k, row[2:]] = 1
        y[k, row[1]] = 1
    totals = np.bincount(group, many, 3)
    if totals[1]:
        many = np.where(group == 1, many * max(totals[0] / 10, totals[2], 1.0) / totals[1], many)
        many = np.where(group == 2, many * max(totals[0] / 10, totals[2], 1.0) / max(totals[2], 1.0), many)
    weights = np.zeros((x.shape[1], LABELS))
    agrees, skips = 0.0, slice(FEATURES + LABELS, FEATURES + 2 * LABELS)
    step, agreed, total = np.zeros_like(weights) + 1e-6, 1e-6, max(1.0, many.sum())
    for _ in range(400):
        chance = _softmax(x @ weights + agrees * x[:, skips])
        slope = x.T @ ((chance - y) * many[:, None]) / total
        slope_agrees = np.trace(slope[skips])
        slope += 1e-5 * weights
        step += slope ** 2
        agreed += slope_agrees ** 2
        weights -= 0.5 * slope / np.sqrt(step)
        agrees -= 0.5 * slope_agrees / np.sqrt(agreed)
    pair = lambda w: (w + w.T) / 2
    return weights[:FEATURES], pair(weights[FEATURES:FEATURES + LABELS]), weights[skips] + agrees * np.eye(LABELS)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def potentials(field: Field, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own potentials of nodes and, after them, hubs; pairs; and the matrix of each pair, from its first to its second."""
    nodes = field.features @ weights[0]
    known = np.flatnonzero(field.known)
    nodes[known] = -30.0
    nodes[known, field.known[known]] = 30.0
    hubs = np.zeros_like(field.hubs)
    seen = field.hubs.sum(axis=1) > 0
    hubs[seen] = np.log(np.maximum(field.hubs[seen] / field.hubs[seen].sum(axis=1, keepdims=True), np.exp(-30.0)))
    pairs = np.concatenate([field.chain, field.skip + np.array([0, len(nodes)])])
    shape = (LABELS, LABELS)
    matrices = np.concatenate([np.broadcast_to(weights[1], (len(field.chain), *shape)), np.broadcast_to(weights[2].T, (len(field.skip), *shape))])
    return np.concatenate([nodes, hubs]), pairs, matrices


def marginals(field: Field, weights: Weights) -> np.ndarray:
    """Each node's chances of the labels, by loopy sum-product messages along chain and skip pairs."""
    own, pairs, matrices = potentials(field, weights)
    if not len(pairs):
        return _softmax(own)[:len(field.spans)]
    kernel = np.exp(np.concatenate([matrices, matrices.transpose(0, 2, 1)]))
    source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    message = np.full((len(source), LABELS), -np.log(LABELS))
    for _ in range(MOST_ROUNDS):
        belief = own.copy()
        np.add.at(belief, target, message)
        sent = np.einsum("el,elm->em", _softmax(belief[source] - message[back]), kernel)
        new = 0.25 * message + 0.75 * np.log(sent / sent.sum(axis=1, keepdims=True))
        change = np.abs(new - message).max()
        message = new
        if change < TOLERANCE:
            break
    belief = own.copy()
    np.add.at(belief, target, message)
    return _softmax(belief)[:len(field.spans)]


def field_spans(text: str, base: list[Span], weights: Weights, sure: float = SURE) -> list[Span]:
    """Free nodes that the field labels."""
    field = Field(text, base)
    if not field.spans:
        return []
    chances = marginals(field, weights)
    label = np.where(chances.max(axis=1) >= sure, chances.argmax(axis=1), 0)
    label[field.known > 0] = 0
    return [(KINDS[label[k] - 1], *field.spans[k]) for k in np.flatnonzero(label).tolist()]


def find_personal(docs: DataFrame, weights: Weights) -> DataFrame:
    """A row for each of docs (doc_id, text): counts of the fixed kinds, the hash of their list, and the list of all spans."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, lists = {kind: [] for kind in KINDS}, [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            for kind in KINDS:
                counts[kind].append(sum(s[0] == kind for s in base))
            hashes.append(hashlib.sha256(listed(base).encode()).hexdigest())
            lists.append(listed(sorted(base + field_spans(text or "", base, model.value), key=lambda s: (KINDS.index(s[0]), s[1]))))
        return batch_of(doc_id=batch.column("doc_id"), **{f"n_{kind}": pa.array(n, pa.int64()) for kind, n in counts.items()},
                        base_sha256=pa.array(hashes, pa.string()), spans=pa.array(lists, pa.string()))

    return map_batches(docs.select("doc_id", "text"), scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def op5_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_personal(docs, learn(docs))
