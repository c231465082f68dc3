"""Fill-in-the-middle, the prefix trie and the quality ledger against brute force, and on odd rows."""
from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlake.llm import fill_middle, prefix_trie, quality
from claimlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n long, form string, output string, n_words long, bits long, source string"
TEXTS = [None, "", "\n", " \n ", "one", "one\n", "a <M> b\nc\n", "<P", "x<\n<P\nS>\n", "É́ 😀\n\n😀 b\r\nç", "long line " * 200_000, "w\n" * 200_000, "\n" * 70_000 + "a\n\n" * 70_000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 1, "f", "o", 2, 3, "s") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], rows[4], (None, "no\nid\nat all\n", None, None, None, None, None, None)], SCHEMA)


# 11: fill in the middle
@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400_000), st.sampled_from([1, 2, 3, 70, 5000]), st.integers(1, 3)), max_size=8))
def test_borders_select_like_a_sorted_list(parts):
    positions = sorted({start + step * i for start, n, step in parts for i in range(n)})
    borders = fill_middle.Borders(np.array(positions, np.int64))
    assert len(borders) == len(positions)
    some = range(len(positions)) if len(positions) < 300 else [*range(0, len(positions), 37), len(positions) - 1]
    assert [borders.select(k) for k in some] == [positions[k] for k in some]


def test_all_kinds_of_containers():
    rng = np.random.default_rng(1)
    kinds = {"run": np.arange(30_000), "bitmap": np.sort(rng.choice(65_536, 20_000, False)), "array": np.sort(rng.choice(65_536, 900, False))}
    for at, (kind, low) in enumerate(kinds.items()):
        borders = fill_middle.Borders(np.concatenate([np.array([5]), low + ((at + 1) << 16)]))
        assert [c.kind for c in borders.containers][1] == kind
        assert [borders.select(k + 1) - ((at + 1) << 16) for k in range(0, len(low), 97)] == low[::97].tolist()


def by_hand(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_brute_force_and_restores(odd):
    made = fill_middle.fill_in_middle(odd)
    got = sorted(made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect(), key=str)
    want = sorted([(r["doc_id"], *by_hand(r["doc_id"], r["text"] or ""), r["text"] or "") for r in odd.collect()], key=lambda r: str(r))
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert fill_middle.fill_in_middle(odd.limit(0)).count() == 0


def test_rates_and_markers(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd\n").alias("text"))
    n = {r["form"]: r["count"] for r in fill_middle.fill_in_middle(docs, seed=3, rate=60, spm=25).groupBy("form").count().collect()}
    assert 700 < n["plain"] < 900 and 230 < n["spm"] < 370
    markers = ("⟨pre⟩", "<suf long>", "m|")
    back = fill_middle.fill_in_middle(docs, markers=markers).select(fill_middle.restored(F.col("output"), F.col("form"), markers).alias("t")).distinct().collect()
    assert [r["t"] for r in back] == ["a\nb\nc\nd\n"]


# 12: prefix trie
def trie_by_hand(turns):
    """turns: {conv_id: [(role, text), ...]}"""
    members = defaultdict(list)
    for c, ts in turns.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        own = (len(cs) - 1) * (len(re.findall(prefix_trie.WORD, p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    return Counter((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(turns[c]) == len(p)).encode()).hexdigest()) for p, cs in members.items())


def some_conversations(seed, n):
    rng = np.random.default_rng(seed)
    for c in range(n):
        kind = rng.integers(0, 3)  # a third are copies of one conversation, a third share first turns
        if kind == 0:
            yield c, [("user", "hi there"), ("assistant", "well, hello to you")]
        else:
            yield c, [("user" if k % 2 else None, f"turn {rng.integers(0, 2 if k < 3 else 50)} of some" if k else None) for k in range(rng.integers(0, 7))]


@pytest.mark.parametrize("shard_turns", [5, 60, prefix_trie.SHARD_TURNS])
def test_trie_equals_brute_force(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    turns = dict(some_conversations(shard_turns, 300))
    rows = [(c, [{"key": hashlib.md5(repr(prefix_of).encode()).hexdigest(), "words": len(re.findall(prefix_trie.WORD, prefix_of[1] or ""))} for prefix_of in ts]) for c, ts in turns.items()]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turns array<struct<key string, words int>>")).collect()
    assert Counter(tuple(r) for r in got) == trie_by_hand({c: [(r, t or "") for r, t in ts] for c, ts in turns.items()})


def test_skeleton_holds_what_spans_shards():
    paths = [bytes([a]) * 16 + bytes([b]) * 16 for a in (1, 2) for b in (1, 2, 3)]
    skeleton = prefix_trie.Skeleton([(paths[1], 1), (paths[4], 4)])
    assert len(skeleton) == 5 and [skeleton.shard(p, i) for i, p in enumerate(paths)] == [0, 1, 1, 1, 2, 2]
    assert skeleton.shard(paths[1], 0) == 0  # a copy with a lower id
    trie = prefix_trie.Trie(paths[1:4])
    assert skeleton.known(1, paths[1:4], trie).tolist() == [0, 1, 2, -1, 3, -1]


def test_trie_query_on_odd_turns(spark, tmp_path):
    rows = [(0, 0, "user", "a b"), (0, None, None, None), (0, 1, "user", None), (0, 1, "user", None), (3, 0, "", "x"), (3, 5, None, "y z"), (3, 5, "b", "y z"),
            (None, 0, "user", "lost"), (25, 0, "user", "a b"), (2**40, 1, "u", "t" * 100_000)]
    data = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn int, role string, text string, words int, key string")
    data.write.parquet(f"{tmp_path}/some/conversations.parquet")
    data.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert QUERIES["op12_prefix_trie"](spark, f"{tmp_path}/none").count() == 0
    got = QUERIES["op12_prefix_trie"](spark, f"{tmp_path}/some").collect()
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}:{r[3] or ''}".encode()).hexdigest())
    own = {c: [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)] for c in (0, 3, 25, 2**40)}
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    again = {c: own.get(c - c % 20, [])[:heads[c]] + ts[heads[c]:] for c, ts in own.items()}
    assert Counter(tuple(r) for r in got) == trie_by_hand(again)


# 13: quality ledger
def measured_by_hand(text):
    words = re.findall(prefix_trie.WORD, text)
    seen, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(prefix_trie.WORD, x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_alpha_words": sum(any(c.isalpha() for c in w) for w in words),
            "n_letters": sum(c.isalpha() for c in text), "n_upper": sum(c.isupper() for c in text)}


def test_measures_equal_brute_force(spark, odd):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("aab   \n\n\t\x0b\r#|A.…É "), rng.integers(0, 400))) for _ in range(300)]
    texts += [" ".join(rng.choice(["a", "b", "c"], n)) for n in range(40)]
    got = {r["doc_id"]: r for r in quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        want = measured_by_hand(text)
        assert {k: got[i][k] for k in want} == want
    rows = quality.ledger(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    for r in (r for r in rows if r["doc_id"] is not None):
        want = measured_by_hand(TEXTS[r["doc_id"]] or "")
        assert {k: r[k] for k in want} == want


def test_rules_fail_once_each(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    good = " ".join(words[:100])
    texts = {"": good, "short": "a few words only", "repeated_words": " ".join(words[:60] + words[:60]), "symbols": " ".join(w + "##" for w in words[:60]),
             "short_words": " ".join(f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"), "long_words": " ".join(w * 3 for w in words[:60]),
             "no_letters": " ".join([*words[:60], *(f"{i}{i}23" for i in range(40))]), "shouting": good.upper(), "bullets": "\n".join(f"- {w} {w}x {w}y" for w in words[:30]),
             "ellipses": "\n".join(f"{w} {w}x {w}y ..." for w in words[:30]), "dup_lines": "\n".join([*words[:150], *(["same"] * 2 + ["line", "of"] * 40)])}
    rows = quality.apply(quality.ledger(spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id string, text string")), quality.POLICIES).collect()
    for r in rows:
        assert quality.BIT.get(r["doc_id"], 0) & r["bits"] == quality.BIT.get(r["doc_id"], 0)
        if r["doc_id"] not in ("short_words", "dup_lines", "symbols"):
            assert r["bits"] == quality.BIT.get(r["doc_id"], 0), r["doc_id"]
        assert r["keeps_strict-1"] == (r["bits"] == 0)
        assert r["keeps_base"] == (r["doc_id"] not in ("short", "repeated_words"))
        if r["doc_id"] in ("bullets", "ellipses", ""):
            assert r["keeps_standard-1"]


def test_ablations_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = quality.ledger(docs, ["source"])
    kept = rows.collect()
    got = {(r["source"], r["version"], r["rule"]): r for r in quality.ablations(rows, by=["source"]).collect()}
    for p in quality.POLICIES:
        for rule, bit in quality.BIT.items():
            for source in {r["source"] for r in kept}:
                if not bit & (p.fatal | p.soft):
                    assert (source, p.version, rule) not in got
                    continue
                mine = [r["bits"] for r in kept if r["source"] == source]
                stays = lambda b, off=0: not b & p.fatal & ~off and (b & p.soft & ~off).bit_count() <= p.most_soft  # noqa: E731, B023
                r = got[source, p.version, rule]
                assert (r["n_docs"], r["n_failed"], r["n_kept"]) == (len(mine), sum(b & bit != 0 for b in mine), sum(map(stays, mine)))
                assert r["n_regained"] == sum(stays(b, bit) and not stays(b) for b in mine)
    some = {r["source"]: r for r in quality.profile(rows, ["source"]).collect()}
    for source, r in some.items():
        mine = [x["bits"] for x in kept if x["source"] == source]
        assert (r["n"], r["any_failed"], r["all_failed"]) == (len(mine), np.bitwise_or.reduce(mine), np.bitwise_and.reduce(mine))
    assert quality.ablations(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="carried"):
        quality.ledger(docs.withColumn("bits", F.lit(1)), ["bits"])


def test_clean_documents_stay(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = QUERIES["op13_quality"](spark, folder).join(labels, "doc_id").where("not base_failed").collect()
    clean, junk = ([r["kept"] for r in got if r["quality"] == q] for q in (1, 0))
    assert sum(clean) >= 0.97 * len(clean) > 0 and sum(junk) < 0.6 * len(junk)
