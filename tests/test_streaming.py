"""Replaying the batch input in three micro-batches leaves what the batch operator gives."""
from pyspark.sql import functions as F

from claimlake.operators import intake, ledger, reviews, search
from claimlake.plans import catalog
from claimlake.plans.tables import AS_OF, Tables
from claimlake.sources import sinks
from claimlake.streaming import command_state, jobs
from claimlake.streaming.current import KeyedTable
from tests.compare import rows_of


def replay(spark, df, order, path):
    """Three files in the order of a column, read one per micro-batch."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    third = (hi - lo) // 3 + 1
    for i in range(3):
        part = df.filter((F.col(order) >= lo + i * third) & (F.col(order) < lo + (i + 1) * third))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    rows = lambda df: rows_of(df.columns, [tuple(map(str, r)) for r in df.collect()])
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a.select(*sorted(a.columns))) == rows(b.select(*sorted(a.columns)))


def finish(query):
    query.awaitTermination()
    assert query.exception() is None
    return query.lastProgress["batchId"]


def test_ingest_stream(spark, folder, tmp_path):
    t = Tables(spark, folder)
    clips = catalog._clip_batch(t)
    stream = replay(spark, clips, "ord", f"{tmp_path}/in")
    last = finish(jobs.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp", AS_OF))
    assert last >= 2
    held = spark.createDataFrame([], jobs.SOURCES)
    want, bad, log = intake.ingest_sources(clips, held, AS_OF)
    got = spark.read.schema(jobs.SOURCES).parquet(f"{tmp_path}/out/sources")
    same(got.select("id", "ord", "path", "body"), want.select("id", "ord", "path", "body"))
    same(spark.read.parquet(f"{tmp_path}/out/quarantine").select("ord", "reason"), bad.select("ord", "reason"))
    assert spark.read.parquet(f"{tmp_path}/out/log").count() == log.count()


def test_command_stream(spark, folder, tmp_path):
    t = Tables(spark, folder)
    commands = t.commands().drop("event_id")
    stream = replay(spark, commands, "seq", f"{tmp_path}/in")
    finish(jobs.command_claims(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    want, audit = ledger.apply_commands(spark.createDataFrame([], jobs.CLAIMS), commands)
    same(jobs.current_claims(spark, f"{tmp_path}/out"), want)
    same(spark.read.parquet(f"{tmp_path}/out/audit").drop("batch"), audit)


def test_command_state_reads_no_table(spark, folder, tmp_path):
    """The third batch goes to an empty folder: all it meets of earlier ones lies in the state."""
    commands = Tables(spark, folder).commands().drop("event_id")
    lo, hi = commands.agg(F.min("seq"), F.max("seq")).first()
    cut = lo + 2 * ((hi - lo) // 3)
    first, last = commands.filter(F.col("seq") <= cut), commands.filter(F.col("seq") > cut)
    stream = lambda: spark.readStream.schema(commands.schema).parquet(f"{tmp_path}/in")
    first.write.mode("append").parquet(f"{tmp_path}/in")
    finish(jobs.command_claims(stream(), f"{tmp_path}/a", f"{tmp_path}/cp"))
    last.write.mode("append").parquet(f"{tmp_path}/in")
    finish(jobs.command_claims(stream(), f"{tmp_path}/b", f"{tmp_path}/cp"))
    want, audit = ledger.apply_commands(spark.createDataFrame([], jobs.CLAIMS), commands)
    touched = last.select("claim_id").distinct()
    same(jobs.current_claims(spark, f"{tmp_path}/b"), want.join(touched, "claim_id", "left_semi"))
    same(spark.read.parquet(f"{tmp_path}/b/audit").drop("batch"), audit.filter(F.col("seq") > cut))


def test_steps_of_one_claim():
    c = {"why": None, "target": None, "born": '{"claim_type": "fact"}', "evidence": None, "text": None, "quote": "", "quoted": "", "by": None, "date": "2024-01-01"}
    state, why = command_state.step(None, {**c, "cmd": "update_text", "text": "x"})
    assert (state, why) == (None, "no such claim")
    state, why = command_state.step(None, {**c, "cmd": "create", "text": "x"})
    assert why is None and state["status"] == "unverified" and state["claim_type"] == "fact"
    assert command_state.step(state, {**c, "cmd": "create"})[1] == "id taken"
    assert command_state.step(state, {**c, "cmd": "update_text", "text": "x"})[1] == "unchanged"
    state, why = command_state.step(state, {**c, "cmd": "promote", "target": "verified", "evidence": '["e"]', "date": "2024-01-02"})
    assert why is None and (state["status"], state["evidence_refs"], state["last_verified"], state["updated"]) == ("verified", ["e"], "2024-01-02", "2024-01-02")
    assert command_state.step(state, {**c, "cmd": "update_text", "text": "y"}) == (state, "not unverified")
    assert command_state.step(state, {**c, "cmd": "set_status", "target": "outdated", "why": "unknown status"}) == (state, "unknown status")
    state, _ = command_state.step(state, {**c, "cmd": "set_status", "target": "outdated", "by": "claim-2"})
    assert state["superseded_by"] == ["claim-2"] and state["last_verified"] == "2024-01-02"


def test_keyed_table_opens_only_touched_buckets(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k bigint, v string, tags array<string>", ("k",), 8)
    rows = lambda ks, v: spark.createDataFrame([(k, v, [v]) for k in ks], table.schema)
    held = lambda t, n=None: {r["k"]: r["v"] for r in t.read(n).collect()}
    assert held(table) == {} and table.holding(rows([1], "x")).count() == 0
    table.merge(rows(range(40), "a"), 0)
    first = table.pointers()
    assert set(first.values()) == {0} and len(first) == 8
    table.merge(rows([3], "b"), 1)
    (touched,) = {r["b"] for r in rows([3], "b").select(table.bucket().alias("b")).collect()}
    assert table.pointers() == {**first, touched: 1}
    assert {p.name for p in (tmp_path / "t" / "rows").glob("*/version=1")} == {"version=1"} and len(list((tmp_path / "t" / "rows").glob("*/version=1"))) == 1
    assert held(table) == {**dict.fromkeys(range(40), "a"), 3: "b"} and held(table, 1) == dict.fromkeys(range(40), "a")
    plan = table.holding(rows([3], "x"))._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(1 paths)" in plan  # of eight buckets one is listed and read
    # again, as after a failure: the same number replaces its own version and sees what was before it
    table.merge(rows([3], "c"), 1)
    assert held(table)[3] == "c" and len(held(table)) == 40
    # several rows of a key are replaced together; keys can go, and with them whole buckets
    table.merge(rows([3, 3], "d"), 2)
    assert sorted(r["v"] for r in table.read().filter("k = 3").collect()) == ["d", "d"]
    table.merge(rows([], "e"), 3, gone=table.read().select("k"))
    assert held(table) == {} and table.pointers() == {}
    table.merge(rows([5], "f"), 4)
    assert held(table) == {5: "f"}


def test_posting_stream_reads_no_history(spark, tmp_path):
    docs = spark.createDataFrame([(i, 1, f"w{i % 7} common") for i in range(200)], "doc_id bigint, seq bigint, text string")
    stream = lambda: spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    docs.write.parquet(f"{tmp_path}/in")
    finish(jobs.index_documents(stream(), f"{tmp_path}/out", f"{tmp_path}/cp"))
    tables = jobs._index_tables(spark, f"{tmp_path}/out")
    before = {name: t.pointers() for name, t in tables.items()}
    change = spark.createDataFrame([(7, 2, "other words"), (8, 2, None)], docs.schema)
    change.write.mode("append").parquet(f"{tmp_path}/in")
    finish(jobs.index_documents(stream(), f"{tmp_path}/out", f"{tmp_path}/cp"))
    moved = {name: {b for b, v in t.pointers().items() if v != before[name].get(b)} for name, t in tables.items()}
    buckets = lambda t, rows: {r["b"] for r in rows.select(t.bucket().alias("b")).collect()}
    assert all(moved[name] <= buckets(tables[name], change) and len(before[name]) == 16 for name in ("docs", "postings"))
    terms = spark.createDataFrame([(w,) for w in "w0 w1 common other words".split()], "term string")
    assert moved["terms"] <= buckets(tables["terms"], terms) and len(moved["terms"]) < 16
    now = docs.filter("doc_id not in (7, 8)").unionByName(change.filter("text is not null"))
    got, want = jobs.current_index(spark, f"{tmp_path}/out"), search.build_index(now.drop("seq"))
    same(got.postings, want.postings)
    same(got.docs, want.docs)
    same(got.terms, want.terms)
    same(got.spread, want.spread)
    same(got.stats, want.stats)


def test_ingest_stream_goes_on_from_its_own_names_and_numbers(spark, tmp_path):
    schema = "path string, ord bigint, origin string, url string, title string, sensitivity string, text string"
    clips = lambda rows: spark.createDataFrame([(f"00_Inbox/{o}.md", o, "web", "", t, "work", f"text {o}") for o, t in rows], schema)
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for part in ([(1, "a"), (2, ""), (3, "source-20240120-040")], [(4, "a"), (5, ""), (6, "b")], [(7, "b"), (8, "")]):
        clips(part).write.mode("append").parquet(f"{tmp_path}/in")
        finish(jobs.ingest(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", "2024-01-20"))
    got = {r["ord"]: (r["id"], r["path"]) for r in spark.read.parquet(f"{tmp_path}/out/sources").collect()}
    assert sorted(got) == [1, 2, 3, 5, 6, 8]
    assert [got[o][0] for o in (1, 2, 3, 5, 6, 8)] == [f"source-20240120-{n:03}" for n in (1, 2, 3, 41, 42, 43)]
    assert {(r["ord"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/out/quarantine").collect()} == {(4, "title taken"), (7, "title taken")}
    assert spark.read.parquet(f"{tmp_path}/out/log").count() == 6


def test_review_stream(spark, folder, tmp_path):
    t = Tables(spark, folder)
    finish(jobs.review_items(replay(spark, t.reviews(), "seq", f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp"))
    same(jobs.reviewed_items(t.items(), f"{tmp_path}/out"), reviews.apply_reviews(t.items(), t.reviews()))


def test_index_line_stream(spark, folder, tmp_path):
    entries = Tables(spark, folder).index_entries()
    finish(jobs.upsert_index(replay(spark, entries, "ord", f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp"))
    same(jobs.current_index_lines(spark, f"{tmp_path}/out"), sinks.upsert_latest(entries).select("id", "line"))


def test_posting_stream(spark, folder, tmp_path):
    t = Tables(spark, folder)
    old = t.snapshot_old().select("doc_id", F.lit(1).cast("bigint").alias("seq"), "text")
    changes = search.snapshot_diff(t.snapshot_old(), t.snapshot_new()).filter("change <> 'same'")
    new = (changes.join(t.snapshot_new(), "doc_id", "left").select("doc_id", F.lit(4).cast("bigint").alias("seq"), "text"))
    stream = replay(spark, old.unionByName(new), "seq", f"{tmp_path}/in")
    finish(jobs.index_documents(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    got, want = jobs.current_index(spark, f"{tmp_path}/out"), search.build_index(t.snapshot_new())
    same(got.terms, want.terms)
    same(got.docs, want.docs)
    same(got.postings, want.postings)


def test_clip_stream(spark, tmp_path):
    from claimlake.sources import corpus
    box = tmp_path / "vault" / "00_Inbox"
    box.mkdir(parents=True)
    (box / "a.md").write_text("---\nurl: https://x.example.org/1\n---\nbody")
    (box / "b.md").write_text("---\nid: source-20240101-001\n---\nbody")
    clips = corpus.stream_clips(spark, str(tmp_path / "vault"))
    query = clips.writeStream.format("memory").queryName("clips").trigger(availableNow=True).start()
    finish(query)
    assert [(r.path, r.url) for r in spark.table("clips").collect()] == [("00_Inbox/a.md", "https://x.example.org/1")]
