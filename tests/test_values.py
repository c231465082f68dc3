"""Hand-checked cases, and an order-dependent fold against a plain loop."""
import datetime as dt
import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake import skew
from claimlake.functions import svg
from claimlake.functions import text as tx
from claimlake.operators import answer, embedding, gates, intake, ledger, lint, pages, progress, quotes, reviews, scoring, search
from claimlake.plans.tables import Tables
from claimlake.schema import CLAIM_STATUSES, COMMANDS
from claimlake.sources import corpus, sinks
from claimlake.streaming.jobs import CLAIMS


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize("text, want", [
    ("React useEffect!!", "react,useeffect"), ("한국어 검색", "한,국,어,한국,국어,검,색,검색"), ("밥", "밥"), ("BM25 한글", "bm25,한,글,한글"), ("", "")])
def test_tokenize(spark, text, want):
    assert ",".join(one(spark, tx.tokenize(F.col("t")), t=text)) == want


def test_keys_and_slugs(spark):
    key = lambda t: one(spark, tx.normalize_key(F.col("t")), t=t)
    assert key("dup one two three") == key("DUP one two three!!") == "dup one three two"
    assert key(" !? ") == "!?"
    assert one(spark, tx.normalize_key(F.col("t"), F.col("s")), t="b a a", s="Kim") == "a a b|kim"
    assert one(spark, tx.slug(F.col("t"), "page"), t=" A 한글/b! ") == "a-한글-b"
    assert one(spark, tx.slug(F.col("t"), "page"), t="!!") == "page"
    assert one(spark, tx.project_slug(F.col("t")), t="/src/My Repo/") == "my-repo"
    assert one(spark, tx.source_filename(F.lit("source-1"), F.col("t")), t="  a/b:c .. ") == "a b c.md"
    assert one(spark, tx.source_filename(F.lit("source-1"), F.col("t")), t="...") == "source-1.md"


def test_whitespace_and_folding(spark):
    assert one(spark, tx.squash(F.col("t")), t=" a 　b\x1cc\n") == "a b c"
    assert one(spark, tx.fold_text(F.col("t")), t="“a”  –​ x…·×") == '"a" - x....x'


def test_quote_marks_need_no_array(spark):
    df = spark.createDataFrame([("\u2028 a\r\nb\x85 \t\x1cc \n\n> \xa0",)], "t string")
    quoted = tx.blockquote(F.col("t"))
    assert df.select(quoted.alias("q")).first().q == "> a\n> b\n>\n> c \n>\n> >"
    taken = tx.extract_quote(F.concat(F.lit(f"x\n{tx.QUOTE_HEADING}\n\n"), quoted))
    assert df.select(taken.alias("q")).first().q == "a\nb\n\nc \n\n>"
    plan = df.select(taken.alias("q"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_quote_blocks(spark):
    quote = "line one\n\n  two\n> three"
    block = one(spark, tx.blockquote(F.col("t")), t=quote)
    assert block == "> line one\n>\n>   two\n> > three"
    assert one(spark, tx.unblockquote(F.col("t")), t=block) == quote
    body = f"## Claim\n\nx\n\n## 원문\n\n{block}\n"
    assert one(spark, tx.extract_quote(F.col("t")), t=body) == quote
    assert one(spark, tx.extract_quote(F.col("t")), t="## 원문\n> at the start") == ""


def test_svg(spark):
    words = "word " * 12
    texts = [f"a<svg x='1'><foreignObject><p>{words}&amp;</p></foreignObject></svg>b", '<SVG aria-label="a plot"></SVG>',
             "<svg><text>x</text>\n<text>y &lt; 2</text></svg>", "<svg><path/></svg>", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(svg.strip_svg(F.col("t")).alias("s")).select("s.*")
    rows = df.collect()
    assert [[r.kind for r in row.report] for row in rows] == [["restored"], ["label"], ["axes"], ["dropped"], []]
    assert rows[0].text == f"a{svg.RESTORED_OPEN}\n\n{words}&\n\n{svg.RESTORED_CLOSE}b"
    assert [r.text for r in rows[1:]] == ["[그림: a plot]", "[그림 텍스트: x y < 2]", "[svg 생략: 18자]", "plain"]
    assert (rows[3].report[0].before, rows[3].report[0].after) == (18, 13)


def test_svg_references_and_several_drawings(spark):
    texts = ["a<svg><text>x &#8217;&#x2014; &mdash;</text></svg>b<svg aria-label=' ' aria-label=\"p\"></svg>c<svg></svg>", "<svg>open", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(svg.strip_svg(F.col("t")).alias("s")).select("s.*").collect()
    assert rows[0].text == "a[그림 텍스트: x ’— —]b[그림: p]c[svg 생략: 11자]"
    assert [tuple(r) for r in rows[0].report] == [("axes", 49, 16), ("label", len("<svg aria-label=' ' aria-label='p'></svg>"), 7), ("dropped", 11, 13)]
    assert rows[1].text == "<svg>open" and rows[1].report == [] and rows[2].text is None


def test_readable_documents_are_found(spark):
    texts = {"rule": "---\nwords after a rule", "empty": "---\ntitle:\n---\nbody", "open": "---\ntitle: x\nno end", "bad": "---\nfoo: [unclosed\n---\nb", "none": None}
    docs = spark.createDataFrame([(f"10_Claims/{k}.md", "10_Claims", i, t) for i, (k, t) in enumerate(texts.items())], "path string, root string, doc_ord bigint, text string")
    parsed = corpus.parse_frontmatter(docs)
    assert {r.title for r in corpus.search_docs(parsed).collect()} == {"rule", "empty", "open"}
    assert {r.path[10:-3] for r in parsed.where("corrupt").collect()} == {"rule", "open", "bad", "none"}


def test_each_text_is_embedded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def ask(texts):
            calls.add(len(texts))
            return [[1.0, float(len(t))] for t in texts]
        return ask
    docs = spark.createDataFrame([(i, "x" * i) for i in range(1, 11)], "doc_id bigint, text string")
    got = embedding.update_cache(embedding.embed_input(docs), str(tmp_path / "once"), make, "m", wait=0.0).collect()
    assert len(got) == calls.value == 10


def test_evidence_and_ids(spark):
    df = spark.createDataFrame([([""],), (["   "],), ([],), (None,), (["", "x"],)], "r array<string>")
    assert [r.x for r in df.select(tx.has_written_evidence(F.col("r")).alias("x")).collect()] == [False] * 4 + [True]
    assert one(spark, tx.doc_id("claim", F.col("d").cast("date"), F.lit(1000)), d="2024-01-02") == "claim-20240102-1000"
    for bad in ("claim-2024-01-02-001", "claim-20240102-1\n", "../claim-20240102-001", "claim-20240102-*"):
        assert not one(spark, tx.is_doc_id(F.col("t"), "claim"), t=bad)


def test_numbers_continue_from_names_and_frontmatter(spark):
    held = spark.createDataFrame([("x", "00_Inbox/source-20240102-007.md"), ("source-20240102-003", "00_Inbox/A title.md"),
                                  ("source-20240103-002", "00_Inbox/B.md")], "id string, path string")
    new = spark.createDataFrame([(1, dt.date(2024, 1, 2)), (2, dt.date(2024, 1, 2)), (3, dt.date(2024, 1, 3)), (4, dt.date(2024, 1, 4))],
                                "ord bigint, day date")
    got = {r.ord: r.id for r in intake.allocate_ids(new, held, "source", "day", "ord").collect()}
    assert got == {1: "source-20240102-008", 2: "source-20240102-009", 3: "source-20240103-003", 4: "source-20240104-001"}


def test_review_ladder(spark):
    items = spark.createDataFrame([("learning-20240101-001", "unknown", dt.date(2024, 1, 1)), ("learning-20240101-002", "rusty", None),
                                   ("learning-20240101-003", "used", dt.date(2024, 1, 5))], "id string, level string, next_review date")
    day = dt.date(2024, 3, 1)
    for n, (level, wait) in enumerate([("seen", 1), ("explained", 3), ("used", 7), ("reviewed", 16), ("can-teach", 35), ("can-teach", 35)], 1):
        rows = [("learning-20240101-001", i, day + dt.timedelta(days=i), True) for i in range(1, n + 1)]
        rows += [("learning-20240101-002", 1, day, False)]
        got = {r.id: r for r in reviews.apply_reviews(items, spark.createDataFrame(rows, "learning_id string, seq bigint, date date, passed boolean")).collect()}
        assert (got["learning-20240101-001"].level, got["learning-20240101-001"].next_review) == (level, day + dt.timedelta(days=n + wait))
        assert (got["learning-20240101-002"].level, got["learning-20240101-002"].next_review) == ("unknown", day + dt.timedelta(days=1))
        assert got["learning-20240101-003"].level == "used"


def play(commands):
    """The ledger one command at a time."""
    claims, audit = {}, {}
    for c in sorted(commands, key=lambda c: c["seq"]):
        k, why = c["claim_id"], None
        now = claims.get(k)
        if c["cmd"] == "create":
            why = "unknown claim_type" if c["claim_type"] != "opinion" else "id taken" if now else None
            if not why:
                claims[k] = {"status": "unverified", "claim": c["new_text"], "quote": c["new_quote"] or "", "evidence": [], "by": []}
        elif c["cmd"] in ("promote", "set_status"):
            verified = c["target"] == "verified"
            if c["cmd"] == "set_status" and verified:
                why = "verified needs promote"
            elif c["target"] not in CLAIM_STATUSES:
                why = "unknown status"
            elif verified and not any(e.strip() for e in c["evidence"]):
                why = "no written evidence"
            elif not now:
                why = "no such claim"
            else:
                now["status"] = c["target"]
                if c["cmd"] == "promote" and c["evidence"]:
                    now["evidence"] = c["evidence"]
                if c["cmd"] == "set_status" and c["superseded_by"]:
                    now["by"] = [c["superseded_by"]]
        else:
            field = "claim" if c["cmd"] == "update_text" else "quote"
            new = c["new_text"] if field == "claim" else c["new_quote"]
            if not c["reason"].strip():
                why = "no reason"
            elif not (new or "").strip():
                why = "no text" if field == "claim" else "no quote"
            elif not now:
                why = "no such claim"
            elif field == "claim" and now["status"] != "unverified":
                why = "not unverified"
            elif now[field] == new:
                why = "unchanged"
            else:
                now[field] = new
        audit[k, c["seq"]] = why
    return claims, audit


@pytest.mark.parametrize("rows_per_range", [1_000_000, 5])
def test_commands_against_a_loop(spark, hot, rows_per_range):
    hot(rows_per_range)
    rng = random.Random(7)
    cmds = []
    for seq in range(1, 601):
        # one claim holds a third of all commands
        k = 1 if rng.random() < 0.33 else rng.randint(2, 12)
        cmds.append({"claim_id": f"claim-20240101-{k:03d}", "seq": seq, "cmd": rng.choice(["create", "promote", "set_status", "update_text", "update_quote"]),
                     "target": rng.choice(["unverified", "unverified", "verified", "disputed", "lost"]), "evidence": rng.choice([[], [""], ["seen"], ["a", "b"]]),
                     "new_text": rng.choice(["t1", "t2", " "]), "new_quote": rng.choice(["q1", "q2", "", None]), "reason": rng.choice(["r", " ", "r"]),
                     "superseded_by": rng.choice([None, "claim-20240101-099"]), "claim_type": rng.choice(["opinion", "rumour"]), "sensitivity": "work",
                     "speaker": None, "source_refs": [], "proposed_status": "", "date": dt.date(2024, 1, 1)})
    frame = spark.createDataFrame([tuple(c[f] for f in COMMANDS.names) for c in cmds], COMMANDS)
    claims, audit = ledger.apply_commands(spark.createDataFrame([], CLAIMS), frame)
    want_claims, want_audit = play(cmds)
    assert {(r.claim_id, r.seq): r.rejection for r in audit.collect()} == want_audit
    got = {r.claim_id: {"status": r.status, "claim": r.claim, "quote": r.quote, "evidence": r.evidence_refs, "by": r.superseded_by} for r in claims.collect()}
    assert got == {k: {**v, "claim": v["claim"], "quote": v["quote"].strip()} for k, v in want_claims.items()}


def claims_frame(spark, rows):
    return spark.createDataFrame(rows, "id string, path string, source_refs array<string>, quote string")


def test_quotes_across_sources(spark):
    sources = spark.createDataFrame([("s1", "p1", "alpha  beta\ngamma"), ("s2", "p2", "delta"), ("s3", "p3", "epsilon zeta" + " filler" * 50)],
                                    "id string, path string, body string")
    rows = [("ok", "1", ["s1"], "alpha beta gamma"), ("letter", "2", ["s1"], "alpha betas"), ("elided", "3", ["s1"], "alpha (...) gamma"),
            ("absent", "4", ["s9"], "alpha"), ("none", "5", ["s1"], ""), ("across", "6", ["s1", "s2", "s3"], "gamma delta epsilon"),
            ("wrong order", "7", ["s2", "s1"], "gamma delta"), ("gap", "8", ["s1", "s3"], "gamma zeta")]
    bad = quotes.quote_not_in_source(claims_frame(spark, rows), sources).collect()
    assert {r.id: r.first_missing for r in bad} == {"letter": "alpha betas", "wrong order": "gamma delta", "gap": "gamma zeta"}


def test_quote_slices(spark):
    sources = spark.createDataFrame([("s1", "p", "## Raw\n\nHe said “yes —  ok”…​ done")], "id string, path string, body string")
    cands = spark.createDataFrame([("exact", "s1", "He said"), ("fixed", "s1", '"yes - ok"...'), ("lost", "s1", "no"), ("other", "s2", "x")],
                                  "key string, source_id string, quote string")
    checked = quotes.check_quotes(cands, sources)
    assert {r.key: (r.status, r.fixed) for r in checked.collect()} == {
        "exact": ("EXACT", None), "fixed": ("FIXED", "“yes —  ok”…"), "lost": ("NOTFOUND", None), "other": (None, None)}
    assert {r.key: r.quote for r in quotes.applied_quotes(checked).collect()}["fixed"] == "“yes —  ok”…"


def test_idf_of_a_term_in_half_the_documents(spark):
    docs = spark.createDataFrame([(1, "cat"), (2, "dog")], "doc_id bigint, text string")
    assert {r.idf for r in search.idf(search.build_index(docs)).collect()} == {0.0}


def search_over(spark, texts, vectors, query, vector, k=8):
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id bigint, doc_ord bigint, text string")
    vecs = None if vectors is None else spark.createDataFrame(list(enumerate(vectors)), "doc_id bigint, vector array<float>")
    asked = spark.createDataFrame([(1, query, vector)], "query_id bigint, q string, vector array<float>")
    found = search.hybrid_search(asked, docs, search.build_index(docs).checkpointed(), vecs, k)
    return [r.doc_id for r in found.orderBy("position").collect()]


def test_search_orders(spark):
    four = ["nothing here", "other words", "rare needle text", "more words"]
    zero = [[0.0, 0.0]] * 4
    assert search_over(spark, four, zero, "needle", [0.0, 0.0])[0] == 2
    assert search_over(spark, four, [[0.0, 1.0], [1.0, 0.0], [0.5, 1.0], [1.0, 1.0]], "unseen", [1.0, 0.0])[:2] == [1, 3]
    assert search_over(spark, four, zero, "  ", [0.0, 0.0]) == []
    assert search_over(spark, four, None, "needle", None) == [2, 0, 1, 3]
    # unmatched documents all tie and come in document order, however many there are
    many = [f"w{i}" for i in range(300)] + ["needle"]
    assert search_over(spark, many, None, "needle", None, k=5) == [300, 0, 1, 2, 3]


def test_gate(spark):
    rows = [(1, "confidential", False), (2, "work", False), (3, "", True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, sensitivity string, pre_ingest boolean")
    sent = lambda blocked: [r.doc_id for r in gates.embed_gate(docs, blocked).filter("send").orderBy("doc_id").collect()]
    assert sent(("confidential",)) == [2] and sent(()) == [1, 2, 3]


def make_fussy():
    calls = {"n": 0}

    def embed(texts):
        calls["n"] += 1
        if calls["n"] == 1:
            raise embedding.Unavailable("busy")
        if any("bad" in t for t in texts) or any(len(t) > 1000 for t in texts):
            raise embedding.Rejected("no")
        return [[1.0, float(len(t))] for t in texts]
    return embed


def test_embedding_salvage_and_cache(spark, tmp_path):
    texts = [(1, "fine"), (2, "bad"), (3, "x" * 3000), (4, "fine")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    path = str(tmp_path / "cache")
    first = {r.doc_id: r.vector for r in embedding.update_cache(embedding.embed_input(docs), path, make_fussy, "m", wait=0.0).collect()}
    assert first == {1: [1.0, 4.0], 2: [0.0, 0.0], 3: [1.0, 750.0], 4: [1.0, 4.0]}
    assert {r.embed_status for r in spark.read.parquet(path).collect()} == {"ok", "refused", "shortened"}

    def refuse():
        raise AssertionError("nothing is missing, so no model is made")
    again = embedding.update_cache(embedding.embed_input(docs), path, refuse, "m", wait=0.0)
    assert {r.doc_id: r.vector for r in again.collect()} == first
    wider = docs.unionByName(spark.createDataFrame([(5, "new")], docs.schema))
    healed = embedding.update_cache(embedding.embed_input(wider), path, lambda: (lambda ts: [[0.0, 0.0, 1.0] for _ in ts]), "m", wait=0.0)
    assert {len(r.vector) for r in healed.collect()} == {3}
    assert embedding.model_tag("remote", "a/b c", 256) == "remote-a-b-c-256d"


def test_an_outage_is_data_and_stops_the_asking(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        seen = {"n": 0}

        def ask(texts):
            calls.add(1)
            seen["n"] += 1
            if seen["n"] > 1:
                raise embedding.Unavailable("down")
            return [[1.0] for _ in texts]
        return ask
    inputs = spark.createDataFrame([(f"k{i}", "t") for i in range(10 * embedding.BATCH)], "key string, input string").coalesce(1)
    rows = Counter((r.embed_status, r.vector is None) for r in embedding.embed(inputs, make, wait=0.0).collect())
    assert rows == {("ok", False): embedding.BATCH, ("unavailable", True): 9 * embedding.BATCH}
    assert calls.value == 1 + embedding.ATTEMPTS  # one batch more was tried, then none

    def broken():
        return lambda texts: []
    with pytest.raises(Exception, match="0 vectors for"):
        embedding.embed(inputs, broken, wait=0.0).collect()


def test_search_goes_on_through_outages_and_recovers(spark, tmp_path):
    docs = spark.createDataFrame([(0, 0, "about plants", "", False), (1, 1, "rank fusion story", "", False), (2, 2, "secret rank", "confidential", False)],
                                 "doc_id bigint, doc_ord bigint, text string, sensitivity string, pre_ingest boolean")
    queries = spark.createDataFrame([(1, "rank fusion"), (2, "plants rank")], "query_id bigint, q string")
    index, sent = search.build_index(docs).checkpointed(), spark.sparkContext.accumulator(0)

    def service(down=()):
        def make():
            def ask(texts):
                sent.add(len(texts))
                if any(word in t for t in texts for word in down):
                    raise embedding.Unavailable("down")
                assert all(t.startswith(("passage: ", "query: ")) and "secret" not in t for t in texts)
                return [[float("plants" in t), float("fusion" in t)] for t in texts]
            return ask
        return make

    def ask(make):
        found = answer.answer(queries.coalesce(1), docs.coalesce(1), index, make, cache_path=str(tmp_path / "cache"), tag="m",
                              prefixes=embedding.E5_PREFIXES, blocked=("confidential",), wait=0.0).collect()
        return {r.query_id: [x.doc_id for x in sorted((x for x in found if x.query_id == r.query_id), key=lambda x: x.position)] for r in found}, {r.degraded for r in found}
    order, degraded = ask(service(down=["passage"]))
    assert degraded == {True} and order[1][0] == 1 and order[2][0] in (0, 2)
    order, degraded = ask(service(down=["query"]))  # the cache fills, the queries get no answer
    assert degraded == {True} and order[1][0] == 1
    sent.value = 0
    order, degraded = ask(service())
    assert degraded == {False} and order[1][0] == 1 and sent.value == 2  # only the two queries were asked
    assert sorted(order[1]) == [0, 1, 2]  # what was not sent is still found


def test_an_outage_while_healing_keeps_the_cache(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string").coalesce(1)
    path = str(tmp_path / "cache")
    embedding.update_cache(embedding.embed_input(docs), path, lambda: (lambda ts: [[1.0] for _ in ts]), "m", wait=0.0)
    wider = embedding.embed_input(docs.unionByName(spark.createDataFrame([(3, "c")], docs.schema)).coalesce(1))

    def make():
        def ask(texts):
            if len(texts) > 1:
                raise embedding.Unavailable("down")
            return [[1.0, 2.0] for _ in texts]
        return ask
    assert embedding.update_cache(wider, path, make, "m", wait=0.0).count() == 0
    assert sorted(len(r.vector) for r in spark.read.parquet(path).collect()) == [1, 1, 2]
    assert embedding.update_cache(wider, path, lambda: (lambda ts: [[1.0, 2.0] for _ in ts]), "m", wait=0.0).count() == 3


def test_upsert_log_and_ledger(spark, tmp_path):
    rows = [("a", 1, "old"), ("a", 2, "new\n line"), ("ab", 1, "mentions [a]")]
    got = sinks.upsert_latest(spark.createDataFrame(rows, "id string, ord bigint, line string"))
    assert {(r.id, r.line) for r in got.collect()} == {("a", "new line"), ("ab", "mentions [a]")}
    lines = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), "x")], "ts timestamp, line string")
    for _ in range(2):
        sinks.append_log(lines, f"{tmp_path}/log")
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/log").collect()] == ["- 2024-01-02T03:04:05 - x"] * 2
    claims = spark.createDataFrame([("c1", "opinion"), ("c2", "deprecated")], "id string, status string")
    sinks.write_ledger(claims, f"{tmp_path}/ledger", "claims")
    sinks.write_ledger(claims.filter("id = 'c2'").withColumn("id", F.lit("c3")), f"{tmp_path}/ledger", "claims")
    assert {(r.id, r.folder) for r in spark.read.parquet(f"{tmp_path}/ledger").collect()} == {("c1", "attributed"), ("c3", "outdated")}


def test_session_text_is_cut_with_a_note(spark):
    rows = [(1, i, "x" * 10000) for i in range(3)] + [(2, 0, "short"), (2, 1, "")]
    got = {r.session: r for r in pages.session_rollup(spark.createDataFrame(rows, "session bigint, turn bigint, text string")).collect()}
    assert got[1].text.endswith("\n[truncated: showing 20000 of 30002 chars]") and len(got[1].text.split("\n[")[0]) == 20000
    assert (got[2].text, got[2].total_chars, got[2].n_entries) == ("short\n", 6, 2)


VAULT = {
    "10_Claims/pending/claim-20240101-001.md": "---\nid: claim-20240101-001\nstatus: verified\nclaim: Dup one two three\nsource_refs:\n- source-20240101-001\nevidence_refs: ['']\n---\n\n## Claim\n\nx\n\n## 원문\n\n> alpha beta\n",
    "10_Claims/pending/claim-20240101-002.md": "---\nid: claim-20240101-002\nstatus: unverified\nclaim: DUP one two three!!\nreview_after: 2024-01-05\n---\n\n## Claim\n\nx\n",
    "10_Claims/outdated/claim-20240101-002.md": "---\nid: claim-20240101-002\nstatus: outdated\nclaim: other\nsource_refs: [source-20990101-001, a book]\n---\nx\n",
    "03_Resources/Concepts/p.md": "---\ntype: concept\nname: P\nclaim_refs: []\n---\nbody\n",
    "00_Inbox/raw/One.md": "---\ntype: source\nid: source-20240101-001\nurl: https://x.example.org/1\n---\n\n## Raw\n\n---\nurl: https://x.example.org/1\n---\nshort text\n",
    "00_Inbox/kept.md": "---\nurl: https://x.example.org/1\n---\nshort  text\n",
    "00_Inbox/new.md": "---\nurl: https://x.example.org/1\n---\nnewer text\n",
    "00_Inbox/broken.md": "---\ntitle: a: b: c\n---\nx\n",
    "06_Metadata/indexes/claim-index.md": "---\nid: claim-20240101-002\n---\n# Claims\n- [claim-20240101-001] a\n- [claim-20240101-009] b\n  - [claim-20240101-010] inside\n",
    "06_Metadata/indexes/wiki-index.md": "- [p] page\n- [Q] none",
    "06_Metadata/indexes/learning-index.md": "- [learning-20240101-001] none\n",
    "06_Metadata/indexes/other-index.md": "- [x] no root\n",
    "01_Projects/a/session-20240101-001.md": "---\nid: session-20240101-001\n---\n",
    "01_Projects/b/session-20240101-001.md": "---\nid: session-20240101-001\n---\n",
    "01_Projects/b/copy.md": "---\nid: session-20240101-001\nsource_refs: source-20990101-007\n---\n",
    "readme.md": "plain",
}


def test_whole_corpus(spark, tmp_path):
    for path, text in VAULT.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text, encoding="utf-8")
    (tmp_path / "00_Inbox/bytes.md").write_bytes(b"\xff\xfe\x00\x00")
    parsed = corpus.parse_frontmatter(corpus.scan_corpus(spark, str(tmp_path), None)).persist()
    found = lint.lint_corpus(parsed, "2024-01-20", corpus.scan_indexes(spark, str(tmp_path))).collect()
    assert sorted((r.check, r.ref) for r in found) == sorted([
        ("status_folder_mismatch", "claim-20240101-001"), ("duplicate_id", "claim-20240101-002"), ("unparseable", "00_Inbox/broken.md"),
        ("unparseable", "00_Inbox/bytes.md"), ("verified_without_evidence", "claim-20240101-001"), ("missing_source_refs", "claim-20240101-002"),
        ("duplicate_claim", "claim-20240101-001, claim-20240101-002"), ("thin_source", "source-20240101-001"), ("quote_not_in_source", "claim-20240101-001"),
        ("stale", "claim-20240101-002"), ("dangling_ref", "claim-20240101-002"), ("index_dangling", "claim-20240101-009"), ("index_dangling", "Q"),
        ("index_dangling", "learning-20240101-001"), ("duplicate_id", "session-20240101-001"), ("dangling_ref", "session-20240101-001"),
        ("orphan_wiki", "P"), ("inbox_ingested_leftover", "00_Inbox/kept.md"), ("inbox_unstructured", "00_Inbox/new.md")])
    assert [r.severity for r in found] == sorted((r.severity for r in found), key=lint.SEVERITIES.index)
    assert {r.message for r in found if r.ref == "session-20240101-001" and r.check == "duplicate_id"} == {"in several files: 01_Projects/b/copy.md, 01_Projects/b/session-20240101-001.md"}
    # what reads the documents: one scan for the facts, and three for the checks that compare bodies
    scans = plan_of(lint.lint_corpus(corpus.parse_frontmatter(corpus.scan_corpus(spark, str(tmp_path), None)), "2024-01-20", None)).count("FileScan binaryFile")
    assert scans <= 3
    seen = corpus.search_docs(corpus.parse_frontmatter(corpus.scan_corpus(spark, str(tmp_path)))).orderBy("doc_ord").collect()
    assert [r.path for r in seen][:2] == ["readme.md", "00_Inbox/kept.md"] and not any(r.path.startswith("06_") for r in seen)
    assert {r.path: r.pre_ingest for r in seen}["00_Inbox/new.md"]
    clips = corpus.clips(parsed)
    held = parsed.filter("root = '00_Inbox' and meta['id'] is not null").selectExpr("meta['id'] id", "meta['url'] url", "body")
    state = progress.vault_state(intake.classify_inbox(clips, held), corpus.claims_of(parsed), corpus.pages_of(parsed),
                                 spark.createDataFrame([], "id string, topic string, level string, next_review date"), "2024-01-20")
    assert progress.next_step(state).collect() == [("unstructured_inbox", 3)]
    parsed.unpersist()


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_a_clip_meets_every_source_of_its_url(spark, hot, hot_rows):
    if hot_rows:
        hot(hot_rows)
    clips = spark.createDataFrame([("a", "u", "x  y"), ("b", "u", "z"), ("c", "v", "x"), ("d", None, "x")], "path string, url string, text string")
    held = spark.createDataFrame([("source-20240101-001", "u", "## Raw\n\nx  y"), ("source-20240101-002", "u", "## Raw\n\nz")], "id string, url string, body string")
    states = sorted((r.path, r.state) for r in intake.classify_inbox(clips, held).collect())
    assert states == [("a", "leftover"), ("a", "pending"), ("b", "leftover"), ("b", "pending"), ("c", "pending"), ("d", "pending")]
    found = sorted((r.path, r.source_id or "", r.state) for r in intake.recaptures(clips, held).collect())
    assert found == [("a", "source-20240101-001", "same"), ("a", "source-20240101-002", "revise"), ("b", "source-20240101-001", "revise"),
                     ("b", "source-20240101-002", "same"), ("c", "", "new"), ("d", "", "new")]


def test_a_large_group_is_one_finding(spark):
    ids = [f"claim-20240101-{i:05d}" for i in range(3 * skew.CHUNK)]
    claims = spark.createDataFrame([(i, "same words", None, f"10_Claims/{i}.md") for i in reversed(ids)], "id string, claim string, speaker string, path string")
    assert [(r.ref, r.message) for r in lint.duplicate_claim(claims).collect()] == [(", ".join(ids), f"same normalized key: {len(ids)} claims")]
    probes = spark.createDataFrame([(1, "Words, same!", None)], "probe_id int, text string, speaker string")
    assert [(r.n, r.ids) for r in ledger.find_similar(probes, claims)[1].collect()] == [(len(ids), ids)]
    files = spark.createDataFrame([(f"a/{i}.md", "x") for i in ids], "path string, id string")
    assert [r.message for r in lint.duplicate_id(files).collect()] == ["in several files: " + ", ".join(f"a/{i}.md" for i in ids)]


def test_next_step_takes_the_first_that_waits(spark):
    state = spark.createDataFrame([("due_reviews", "a"), ("wiki_pages", "b")], "stage string, id string")
    assert progress.next_step(state).collect() == [("due_reviews", 1)]
    assert progress.next_step(state.filter("stage = 'wiki_pages'")).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, folder):
    t = Tables(spark, folder)
    index = search.build_index(t.documents())
    assert "Exchange hashpartitioning(doc_id" not in plan_of(search.build_index(t.raw("documents")).postings)
    scored = search.bm25(t.queries(), index.checkpointed())
    assert "CartesianProduct" not in plan_of(scored) and "NestedLoop" not in plan_of(scored)
    # what meets by a shuffle in a search are lists that tasks have cut, documents with their own terms, and blocks; no pairs
    for vectors in (t.vectors(), None):
        plan = plan_of(search.hybrid_search(t.queries(), t.search_documents(), index.checkpointed(), vectors))
        assert "CartesianProduct" not in plan and "explode(batch" not in plan
    plan = plan_of(search.nearest(t.queries(), t.vectors()))
    assert plan.index("MapInArrow") > plan.index("Exchange") and "NestedLoop" not in plan and "CartesianProduct" not in plan_of(search.cosine(t.queries(), t.vectors()))
    for df in (quotes.quote_not_in_source(t.claims(), t.sources().withColumn("path", F.col("id"))),
               intake.classify_inbox(t.clips(), t.page_sources()), lint.duplicate_claim(t.claims())):
        assert "NestedLoop" not in plan_of(df) and "CartesianProduct" not in plan_of(df) and "Window" not in plan_of(df)
    assert "ReadSchema: struct<url:string>" in t.raw("pages").select("url")._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).columns == ["query_id", "position", "doc_id", "bm_rank", "cos_rank", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_slices_against_a_character_loop():
    import pandas as pd
    table = {**dict(zip(tx.FOLD_FROM, tx.FOLD_TO)), **dict.fromkeys(tx.FOLD_DROP, ""), tx.ELLIPSIS: "..."}

    def slow(text):
        shown, places, space = [], [], False
        for i, ch in enumerate(text):
            rep = table.get(ch, ch)
            if rep.isspace():
                if space:
                    continue
                rep, space = " ", True
            else:
                space = False
            shown += rep
            places += [i] * len(rep)
        return "".join(shown), places

    rng = random.Random(3)
    for _ in range(400):
        body = "".join(rng.choice("ab  \n\t ⠀​…’—.x　") for _ in range(30))
        folded, places = slow(body)
        lo = rng.randrange(len(folded))
        want = folded[lo:lo + rng.randint(1, 8)]
        at = folded.find(slow(want)[0])
        expected = body[places[at]:places[at + len(slow(want)[0]) - 1] + 1] if at >= 0 else None
        assert quotes._slices(pd.Series([body]), pd.Series([want]))[0] == expected


def test_a_term_repeated_very_often(spark):
    docs = spark.createDataFrame([(1, "the then " + "the " * 200_000), (2, ""), (3, None)], "doc_id bigint, text string")
    index = search.build_index(docs)
    assert {(r.doc_id, r.term, r.tf) for r in index.postings.collect()} == {(1, "the", 200_001), (1, "then", 1)}
    assert {r.doc_id: r.dl for r in index.docs.collect()} == {1: 200_002, 2: 0, 3: 0}


def test_cosine_of_more_queries_than_a_batch(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MOST_QUERIES", 256)
    n = 2 * scoring.MOST_QUERIES + 7
    queries = spark.createDataFrame([(i % (n - 3), "q", [float(i), 1.0]) for i in range(n)], "query_id long, q string, vector array<float>")
    vectors = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(3)], "doc_id long, vector array<float>")
    got = sorted((r["query_id"], r["doc_id"], round(r["cos"], 6)) for r in search.cosine(queries, vectors).collect())
    assert got == sorted((i % (n - 3), k, round((i + k) / ((i * i + 1) * (1 + k * k)) ** 0.5, 6)) for i in range(n) for k in range(3))


ODD_VECTORS = [[1.0, 0.0], [0.0, 0.0], None, [], [1.0, 2.0, 3.0], [None, 1.0], [float("nan"), 1.0], [-1.0, 0.5], [3.0, 0.0]]


def test_nearest_keeps_ties_in_order_and_leaves_odd_vectors_at_zero(spark):
    vectors = spark.createDataFrame([(f"v{i}", v) for i, v in enumerate(ODD_VECTORS)], "doc_id string, vector array<float>")
    queries = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 2.0, 3.0]), (3, " ", [1.0, 0.0]), (4, "c", None)], "query_id long, q string, vector array<float>")
    got = {q: [(r.doc_id, round(r.cos, 6)) for r in search.nearest(queries, vectors, 4).orderBy("query_id", "position").collect() if r.query_id == q] for q in (1, 2, 3, 4)}
    assert got == {1: [("v0", 1.0), ("v8", 1.0), ("v1", 0.0), ("v2", 0.0)], 2: [("v4", 1.0), ("v0", 0.0), ("v1", 0.0), ("v2", 0.0)],
                   3: [], 4: [("v0", 0.0), ("v1", 0.0), ("v2", 0.0), ("v3", 0.0)]}
    assert search.nearest(queries, vectors.limit(0)).count() == 0 and search.nearest(queries.limit(0), vectors).count() == 0


def fused_by_hand(texts, vectors, query, vector, k):
    """The k best by reciprocal ranks, from whole lists of scores."""
    said = [[w for w in t.split()] for t in texts]
    n, avgdl = len(texts), sum(map(len, said)) / len(texts)
    df = Counter(w for ws in said for w in set(ws))
    raw = {w: round(math.log(n - f + 0.5) - math.log(f + 0.5), 12) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: round(0.25 * mean, 12) if x < 0 else x for w, x in raw.items()}
    bm = [round(sum(math.floor(idf[w] * (ws.count(w) * 2.5) / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) * 1e12 + 0.5) for w in query.split() if w in ws) / 1e12, 9) for ws in said]
    length = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    cos = [round(sum(a * b for a, b in zip(v, vector)) / length(v) / length(vector), 9) for v in vectors] if vectors else [0.0] * n
    ranks = [[sum(y > x for y in scores) for x in scores] for scores in (bm, cos)]
    best = sorted(range(n), key=lambda i: (-(1 / (60 + ranks[0][i]) + 1 / (60 + ranks[1][i])), i))[:k]
    return [(i, ranks[0][i], ranks[1][i]) for i in best]


@pytest.mark.parametrize("by_vector", [True, False])
@pytest.mark.parametrize("batch", [2, 4096])
def test_search_equals_whole_lists(spark, monkeypatch, by_vector, batch):
    monkeypatch.setattr(scoring, "MOST_QUERIES", batch)
    monkeypatch.setattr(scoring, "BLOCK", 500)  # many small blocks, lists cut often
    rng = random.Random(by_vector)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(1, 40))) for _ in range(300)] + ["w1 w2 w59 w58"] * 60
    vectors = [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in texts]
    asked = [(q, " ".join(rng.choices(words, k=4)), [float(rng.randint(-2, 2)) for _ in range(3)]) for q in range(5)] + [(9, "w59 w58", [0.0, 0.0, 1.0]), (10, "unseen", [1.0, 1.0, 0.0])]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id bigint, doc_ord bigint, text string")
    vecs = spark.createDataFrame(list(enumerate(vectors)), "doc_id bigint, vector array<float>") if by_vector else None
    found = search.hybrid_search(spark.createDataFrame(asked, "query_id bigint, q string, vector array<float>"), docs.repartition(5), search.build_index(docs).checkpointed(), vecs, 8).collect()
    for q, text, vector in asked:
        got = [(r.doc_id, r.bm_rank, r.cos_rank) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.position)]
        assert got == fused_by_hand(texts, vectors if by_vector else None, text, vector, 8), text


def test_blocks_that_cannot_reach_are_skipped(spark, tmp_path):
    # short texts that hold rare words often, among many long ones that hold them once beside much else
    texts = [f"rare{i % 3} " * (3 if i < 30 else 1) + " ".join(f"x{(i * 7 + j) % 900}" for j in range(3 if i < 30 else 120)) + " common" for i in range(1500)]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id bigint, doc_ord bigint, text string")
    queries = spark.createDataFrame([(q, f"rare{q} common") for q in range(3)], "query_id bigint, q string")
    index = search.build_index(docs).checkpointed()
    asked, terms = search._asked(queries, index)
    search.block_postings(index).save(f"{tmp_path}/blocks")
    blocks = search.Blocks.load(spark, f"{tmp_path}/blocks")
    number = search._numbered(spark, "term", terms, "term_no", T.StringType())
    own, heads = blocks.postings.join(number, "term"), blocks.heads.join(number, "term")
    run = search.BlockSearch(asked, own, heads, docs, 8)
    first = run.scored(run.probes(), np.zeros(3))
    reached = heads.join(run.reaching(run.least(first)).union(run.probes()).distinct(), "range", "left_semi").count()
    assert 0 < reached < 0.2 * heads.count()  # more than four of five blocks are neither read nor scored
    got = sorted((asked.ids[r["query_no"]], r["doc_id"], r["bm"]) for r in run.found().collect())
    whole = search.bm25(queries, index).collect()
    assert got == sorted((q, r["doc_id"], r["bm"]) for q in range(3) for r in sorted((r for r in whole if r["query_id"] == q), key=lambda r: (-r["bm"], r["doc_id"]))[:8])
    most = own.groupBy("term", "range").count().groupBy("term").agg(F.max("count").alias("n"), F.count("*").alias("blocks")).collect()
    assert max(r["n"] for r in most) < 80 and max(r["blocks"] for r in most) > 60  # a hot term is cut into many blocks
    found = search.hybrid_search(queries, docs, index, None, 8, blocks).collect()
    assert {(r["query_id"], r["doc_id"]) for r in found} == {(q, d) for q, d, _ in got}


def test_numbers_by_prefix_sums(spark):
    rng = random.Random(4)
    rows = [("hot", i, "x" * 50) for i in rng.sample(range(10**6), 3000)] + [(f"k{i % 40}", i, "y") for i in range(400)] + [(None, i, "z") for i in range(30)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, ord bigint, text string").repartition(7)
    after = spark.createDataFrame([("hot", 10), ("k3", 5), ("other", 1)], "k string, top bigint")
    got = {(r.k, r.ord): (r.n, r.text) for r in skew.with_numbers(frame, ["k"], "ord", "n", after).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        first = {"hot": 10, "k3": 5}.get(key, 0)
        want |= {(key, o): (first + i, t) for i, (o, t) in enumerate(sorted((o, t) for k, o, t in rows if k == key), 1)}
    assert got == want and skew.with_numbers(frame.limit(0), ["k"], "ord", "n").count() == 0
    with pytest.raises(Exception, match="share their ord"):
        skew.with_numbers(frame.unionByName(frame.limit(5)), ["k"], "ord", "n").collect()
    numbered = skew.with_numbers(frame.withColumn("day", F.lit("2024-01-20")), ["day"], "ord", "n")
    plan = plan_of(numbered)
    assert "SinglePartition" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert not any("text" in line for line in plan.splitlines() if "Window" in line)


def test_refreshed_index_equals_a_rebuild(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choices(["a", "b", "c", "dd", "ee", "rare"], [9, 7, 5, 3, 2, 1], k=rng.randint(0, 8)))
    snap = {i: text() for i in range(60)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id bigint, text string")
    index = search.build_index(frame(snap)).checkpointed()
    for step in range(3):
        after = {i: (text() if rng.random() < 0.2 else t) for i, t in snap.items() if rng.random() < 0.9} | {100 * (step + 1) + i: text() for i in range(5)}
        if step == 2:
            after = {}
        index = search.refresh_index(index, search.snapshot_diff(frame(snap) if snap else frame({0: ""}).limit(0), frame(after) if after else frame({0: ""}).limit(0)),
                                     frame(after) if after else frame({0: ""}).limit(0))
        want = search.build_index(frame(after) if after else frame({0: ""}).limit(0))
        for name in ("docs", "postings", "terms", "spread", "stats"):
            got, exp = (sorted(map(str, getattr(x, name).select(*sorted(getattr(want, name).columns)).collect())) for x in (index, want))
            assert got == exp, (step, name)
        snap = after


def test_sums_round_half_up_as_in_the_jvm():
    asked = scoring.Queries([1], starts=np.array([0, 1]), queries=np.array([0]), times=np.array([1]), idf=np.array([1.0]))
    whole = np.array([12_345_678_500, 12_345_678_499, 500, 499], np.int64) / 1e12
    got = [scoring.lexical(replace(asked, idf=np.array([x])), np.array([0]), np.array([0]), np.array([1]), np.array([1]), 1)[0, 0] for x in whole]
    assert got == [0.012345679, 0.012345678, 1e-9, 0.0]


def test_rows_without_a_key_are_spread(spark):
    big = spark.range(4000).selectExpr("id", "case when id % 4 = 0 then cast(id as string) end k")
    small = spark.range(0, 4000, 8).selectExpr("cast(id as string) k", "id v")
    was = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = skew.skew_join(big, small, ["k"], "left", ["id"])
        rows = joined.withColumn("part", F.spark_partition_id()).collect()
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    assert max(Counter(r.part for r in rows if r.k is None).values()) < 1000
    assert {r.id: r.v for r in rows} == {i: i if i % 8 == 0 else None for i in range(4000)} and joined.columns == ["k", "id", "v"]


def test_lists_and_postings_are_held_in_portions():
    best = scoring.Best(40, 8)
    for block in range(200):  # each block better than all before it
        best.add(np.full((1000, 40), float(block)), None, np.arange(1000), np.arange(1000))
        assert best.held <= 4 * 8 * 40 + scoring.SPARE + 40_000
    assert set(best.cut()[1]) == {199.0}
    asked = scoring.Queries(list(range(1000)), starts=np.array([0, 1000]), queries=np.arange(1000), times=np.ones(1000, np.int64), idf=np.ones(1), avgdl=2.0)
    terms = np.zeros(1200, np.int64)
    cut = list(scoring.portions(asked, terms))
    assert [x for s in cut for x in range(s.start, s.stop)] == list(range(1200)) and max(s.stop - s.start for s in cut) * 1000 <= scoring.PAIRS


def test_embedding_makes_few_texts_at_once(spark):
    from claimlake.plans.catalog import letter_embedder
    inputs = spark.range(300).selectExpr("cast(id as string) key", "repeat('a', cast(id as int)) input")
    done = embedding.embed(inputs, letter_embedder, 0.0)
    assert "MapInPandas" not in plan_of(done)
    assert {r.key: (r.vector[0], r.embed_status) for r in done.collect()} == {str(i): (float(i), "ok") for i in range(300)}


def test_an_index_is_read_and_counted_once(spark, folder):
    t = Tables(spark, folder)
    assert "FileScan" not in plan_of(search.postings(t.documents()))
    kept = search.build_index(t.documents()).checkpointed()
    assert "Aggregate" not in plan_of(kept.terms) and "Aggregate" not in plan_of(search.idf(kept).drop("idf"))
