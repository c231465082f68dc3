"""Named queries over one data folder: every operator applied to whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.functions import html
from claimlake.functions import text as tx
from claimlake.operators import answer, embedding, gates, intake, ledger, lint, pages, progress, quotes, reviews, search
from claimlake.plans.tables import AS_OF, Tables
from claimlake.schema import CLAIM_TYPES, SENSITIVITIES
from claimlake.sources import corpus, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


def _joined(col: str):
    return F.array_join(col, ",")


# --- scans, sinks ---------------------------------------------------------------------------------------------------

@query
def frontmatter_roundtrip(t: Tables) -> DataFrame:
    """Claims rendered as Markdown and parsed back."""
    docs = sinks.render_claims(t.claims()).select("path", F.lit("10_Claims").alias("root"), F.col("path").alias("doc_ord"), "text")
    return corpus.claims_of(corpus.parse_frontmatter(docs)).select(
        "id", "claim_type", "status", "claim", "speaker", "sensitivity", "folder", _joined("source_refs").alias("source_refs"),
        F.size("evidence_refs").alias("n_evidence"), "quote")


@query
def search_docs(t: Tables) -> DataFrame:
    docs = sinks.render_claims(t.claims()).select("path", F.lit("10_Claims").alias("root"), F.col("path").alias("doc_ord"), "text")
    return corpus.search_docs(corpus.parse_frontmatter(docs)).select("ref", "title", "text", "path", "sensitivity", "pre_ingest")


@query
def index_upsert(t: Tables) -> DataFrame:
    return sinks.upsert_latest(t.index_entries()).select("id", "line")


@query
def status_folder(t: Tables) -> DataFrame:
    return sinks.with_ledger_folder(t.claims().drop("folder"), "claims").groupBy("status", "folder").agg(F.count(F.lit(1)).alias("n"))


@query
def page_folder(t: Tables) -> DataFrame:
    return sinks.with_ledger_folder(t.pages(), "pages").select("name", "folder")


@query
def render_claims(t: Tables) -> DataFrame:
    return sinks.render_claims(t.claims())


@query
def render_sources(t: Tables) -> DataFrame:
    s = t.sources().withColumn("path", F.concat(F.lit("00_Inbox/raw/"), "id", F.lit(".md")))
    return sinks.render_sources(s).select("path", F.md5("text").alias("digest"), F.length("text").alias("chars"))


@query
def review_packet(t: Tables) -> DataFrame:
    return quotes.review_packet(t.claims(), "claim-")


@query
def review_json(t: Tables) -> DataFrame:
    docs = quotes.review_json(t.claims(), t.sources().withColumn("path", F.col("id")))
    return docs.select("source_id", "n_claims", "flagged", F.get_json_object("doc", "$.claims[0].id").alias("first_id"),
                       F.get_json_object("doc", "$.source.title").alias("title"))


# --- gates ----------------------------------------------------------------------------------------------------------

@query
def quarantine(t: Tables) -> DataFrame:
    odd = t.claims().withColumn("claim_type", F.expr("case when doc_id % 10 = 3 then 'rumour' else claim_type end")) \
        .withColumn("sensitivity", F.expr("case when doc_id % 15 = 4 then 'secret' else sensitivity end"))
    ok, bad = gates.quarantine(odd, {"unknown claim_type": gates.outside(F.col("claim_type"), CLAIM_TYPES),
                                     "unknown sensitivity": gates.outside(F.col("sensitivity"), SENSITIVITIES)})
    return ok.select("id", F.lit("").alias("reason")).unionByName(bad.select("id", "reason"))


@query
def id_shape(t: Tables) -> DataFrame:
    made = t.documents().select("doc_id", F.explode(F.expr(
        """array(concat('source-20240101-', doc_id), concat('claim-2024010-', doc_id), concat('claim-20240101-', doc_id, 'x'),
                 concat('note-20240101-', doc_id), concat('decision-20240101-', doc_id, char(10)))""")).alias("ref"))
    return made.groupBy("doc_id").agg(F.count_if(tx.is_doc_id(F.col("ref"), *lint.ID_PREFIXES)).alias("n_ids"),
                                      F.count_if(tx.is_doc_id(F.col("ref"), "source")).alias("n_sources"))


@query
def botwall(t: Tables) -> DataFrame:
    walls = F.expr("""case doc_id % 9 when 0 then concat(text, ' Attention Required! | Cloudflare')
        when 1 then concat('JavaScript is not available', text, 'Checking if the site connection is secure')
        when 2 then concat(text, ' enable javascript') else text end""")
    return t.documents().select("doc_id", tx.bot_wall(walls).alias("marker"))


@query
def list_pending(t: Tables) -> DataFrame:
    return gates.list_pending(t.claims())


@query
def due_reviews(t: Tables) -> DataFrame:
    return gates.due_reviews(t.items(), AS_OF)


@query
def embed_gate(t: Tables) -> DataFrame:
    return gates.embed_gate(t.search_documents(), ("confidential",)).select("doc_id", "send")


# --- capture and cleaning -------------------------------------------------------------------------------------------

def _drawings(t: Tables) -> DataFrame:
    return t.html().selectExpr("page_id", """case page_id % 5
        when 0 then concat(html, '<svg width="9"><foreignObject><p>', url, ' drawn as text in the page &amp; kept</p></foreignObject></svg>')
        when 1 then concat('<svg aria-label="', url, '"></svg>', html)
        when 2 then concat(html, '<svg><text>', page_id, '</text><text> axis</text></svg><svg></svg>')
        when 3 then concat('<SVG><path d="', url, '"/></SVG>', html) else html end text""")


@query
def svg_report(t: Tables) -> DataFrame:
    return intake.svg_report(_drawings(t), "page_id", "text")


@query
def svg_totals(t: Tables) -> DataFrame:
    return intake.svg_totals(_drawings(t), "text")


@query
def html_markdown(t: Tables) -> DataFrame:
    return t.html().select("page_id", html.html_to_markdown(F.col("html")).alias("markdown"))


@query
def safe_title(t: Tables) -> DataFrame:
    title = F.expr("case doc_id % 7 when 0 then '' when 1 then ' .?.' when 2 then concat('a/b:c', split(text, '\\n')[0], '. ') else text end")
    return t.documents().select("doc_id", tx.source_filename(F.concat(F.lit("source-"), "doc_id"), title).alias("file"))


@query
def slug(t: Tables) -> DataFrame:
    line = F.split("text", "\n")[0]
    return t.documents().select("doc_id", tx.slug(line, "page").alias("page"),
                                tx.project_slug(F.concat(F.lit("/src/"), line, F.lit("/"))).alias("project"))


def _clip_batch(t: Tables) -> DataFrame:
    return t.documents().selectExpr(
        "concat('00_Inbox/', doc_id, '.md') path", "doc_id ord", "'web' origin", "concat('https://x.example.org/', doc_id) url",
        "case when doc_id % 4 = 0 then '' else concat('Note ', doc_id div 2) end title",
        "case doc_id % 21 when 5 then 'secret' else 'work' end sensitivity",
        "case doc_id % 13 when 6 then concat(text, 'JavaScript is not available') else text end text")


def _held(t: Tables) -> DataFrame:
    return t.sources().selectExpr("id", "case when doc_id % 6 = 1 then concat('00_Inbox/raw/Note ', doc_id, '.md') "
                                        "else concat('00_Inbox/raw/', id, '.md') end path")


@query
def ingest_sources(t: Tables) -> DataFrame:
    sources, bad, _ = intake.ingest_sources(_clip_batch(t), _held(t), AS_OF)
    kept = sources.select("ord", "id", "path", F.lit("").alias("reason"), F.length("body").alias("chars"))
    return kept.unionByName(bad.select("ord", F.lit("").alias("id"), F.lit("").alias("path"), "reason", F.lit(0).alias("chars")))


def _revisions(t: Tables) -> DataFrame:
    first = t.sources().selectExpr("id source_id", "1L seq", """case doc_id % 5 when 0 then substr(body, 9) when 1 then ' '
        when 2 then 'JavaScript is not available' else concat(substr(body, 9), ' again') end content""",
                                   "case when doc_id % 7 = 0 then ' ' else 'recapture' end reason")
    second = t.sources().filter("doc_id % 2 = 0").selectExpr(
        "case when doc_id % 12 = 0 then 'source-20990101-001' else id end source_id",
        "case when doc_id % 12 = 0 then doc_id + 3 else 2L end seq", "concat(substr(body, 9), ' again') content", "'second' reason")
    return first.unionByName(second)


@query
def revise_sources(t: Tables) -> DataFrame:
    return intake.revise_sources(t.sources().withColumn("path", F.col("id")), _revisions(t))[1]


@query
def revised_bodies(t: Tables) -> DataFrame:
    revised = intake.revise_sources(t.sources().withColumn("path", F.col("id")), _revisions(t))[0]
    return revised.select("id", F.md5("body").alias("digest"))


@query
def triage(t: Tables) -> DataFrame:
    decisions = t.sources().selectExpr("doc_id", """case doc_id % 10 when 0 then 'source-20990101-001' when 1 then '../x' else id end source_id""",
                                       "case doc_id % 4 when 0 then 'drop' when 1 then 'deep' when 2 then 'keep-as-link' else 'later' end decision")
    sources = t.sources().selectExpr("id", "concat('00_Inbox/raw/', id, '.md') path")
    return intake.triage(sources, decisions).select("doc_id", "decision", "rejection", "line")


@query
def inherit_sensitivity(t: Tables) -> DataFrame:
    k = t.claims().withColumn("source_refs", F.expr("concat(source_refs, array(replace(replace(id, 'claim', 'source'), '2024010', '2024011'), 'a book'))"))
    return gates.inherit_sensitivity(k, t.sources()).select("id", "inherited")


@query
def allocate_ids(t: Tables) -> DataFrame:
    new = t.sources().select("doc_id", F.date_add("captured_at", 15).alias("day"))
    existing = t.sources().selectExpr("case when doc_id % 3 = 0 then 'x' else id end id", "concat('00_Inbox/', id, '.md') path")
    return intake.allocate_ids(new, existing, "source", "day", "doc_id").select("doc_id", "id")


@query
def inbox_classify(t: Tables) -> DataFrame:
    return intake.classify_inbox(t.clips(), t.page_sources())


@query
def resolve_source(t: Tables) -> DataFrame:
    files = t.sources().selectExpr("id", "case when doc_id % 2 = 0 then concat('00_Inbox/raw/Title ', doc_id, '.md') else concat('00_Inbox/raw/', id, '.md') end path")
    copies = t.sources().filter("doc_id % 10 = 0").selectExpr("'' id", "concat('00_Inbox/old/', id, '.md') path")
    ids = t.sources().selectExpr("case when doc_id % 9 = 0 then concat(id, '99') else id end id")
    return intake.resolve_sources(ids, files.unionByName(copies))


@query
def recapture(t: Tables) -> DataFrame:
    return intake.recaptures(t.clips(), t.page_sources())


@query
def clip_title(t: Tables) -> DataFrame:
    body = F.concat(F.lit("---\nurl: x\n"), F.expr("case when doc_id % 3 = 0 then '' else concat('  title: \"', split(text, '\\n')[0], '\"  ', char(10)) end"),
                    F.lit("---\n"), "text")
    return t.documents().select("doc_id", tx.clip_title(body).alias("title"))


# --- claim ledger ---------------------------------------------------------------------------------------------------

def _start(t: Tables) -> DataFrame:
    """Every third claim exists before the commands come."""
    none = "cast(array() as array<string>)"
    return t.items().filter("user_id % 3 = 0").selectExpr(
        "replace(id, 'learning', 'claim') claim_id", "'observation' claim_type", "'unverified' status", "'' proposed_status",
        "'text 1' claim", "cast(null as string) speaker", f"{none} source_refs", f"{none} evidence_refs", "'work' sensitivity",
        "'quote 2' quote", f"{none} superseded_by", "DATE'2023-12-01' created", "DATE'2023-12-01' updated", "cast(null as date) last_verified")


@query
def apply_commands(t: Tables) -> DataFrame:
    return ledger.apply_commands(_start(t), t.commands())[1]


@query
def commanded_claims(t: Tables) -> DataFrame:
    return ledger.apply_commands(_start(t), t.commands())[0].select(
        "claim_id", "status", "folder", "claim", "quote", _joined("evidence_refs").alias("evidence_refs"),
        _joined("superseded_by").alias("superseded_by"), "created", "updated", "last_verified")


@query
def current_claims(t: Tables) -> DataFrame:
    return ledger.current_claims(t.claim_files()).select("id", "folder", "status", "path")


@query
def normalize_key(t: Tables) -> DataFrame:
    return ledger.with_key(t.claims()).select("id", "key")


def _reworded():
    """The first line in another case and punctuation."""
    return F.replace(F.lower(F.split("text", "\n")[0]), F.lit(" "), F.lit(" - "))


@query
def find_similar(t: Tables) -> DataFrame:
    probes = t.documents().select(F.col("doc_id").alias("probe_id"), _reworded().alias("text"),
                                  F.expr("case when doc_id % 4 = 0 then concat('SPK', doc_id % 2) end").alias("speaker"))
    return ledger.find_similar(probes, t.claims())[0]


@query
def similar_members(t: Tables) -> DataFrame:
    probes = t.documents().select(
        F.col("doc_id").alias("probe_id"), _reworded().alias("text"), F.lit("").alias("speaker"))
    return ledger.find_similar(probes, t.claims())[1].select("key", "n", _joined("ids").alias("ids"))


@query
def quote_block(t: Tables) -> DataFrame:
    quoted = tx.blockquote(F.col("text"))
    body = F.concat(F.lit(f"## Claim\n\nx\n\n{tx.QUOTE_HEADING}\n\n"), quoted, F.lit("\n"))
    return t.documents().select("doc_id", F.md5(quoted).alias("quoted"), F.md5(tx.extract_quote(body)).alias("extracted"))


# --- pages, project documents, learning ------------------------------------------------------------------------------

@query
def create_pages(t: Tables) -> DataFrame:
    none = "cast(array() as array<string>)"
    new = t.documents().selectExpr(
        "doc_id ord", "concat('Conv ', doc_id div 3) name", "case doc_id % 11 when 7 then 'essay' when 8 then 'pattern' else 'concept' end type",
        f"{none} domain", f"{none} aliases", "'work' sensitivity", f"{none} claim_refs", "text body")
    created, bad = pages.create_pages(new, t.pages(), AS_OF)
    return created.select("name", "type", "slug", "path", F.lit("").alias("reason")).unionByName(
        bad.select("name", "type", "slug", F.lit("").alias("path"), "reason"))


@query
def update_pages(t: Tables) -> DataFrame:
    base = t.pages().withColumns({"status": F.lit("draft"), "aliases": F.array().cast("array<string>"), "body": F.lit("old"),
                                  "updated": F.lit("2024-01-01").cast("date")})
    patches = t.sessions().selectExpr(
        "concat('conv ', session) name", "turn seq",
        "array(format_string('claim-20240101-%03d', turn % 3), format_string('claim-20240105-%03d', session div 10 + 1)) add_refs",
        "case when turn % 2 = 1 then array(role) end aliases", "case when turn = 2 then 'reviewed' else '' end status",
        "case when turn % 3 = 0 then text end body", "date_add(DATE'2024-01-02', cast(turn as int)) date")
    return pages.update_pages(base, patches).select("name", _joined("claim_refs").alias("claim_refs"), _joined("aliases").alias("aliases"),
                                                    "status", F.md5("body").alias("body"), "updated")


@query
def project_docs(t: Tables) -> DataFrame:
    new = t.sessions().filter("turn = 0").selectExpr(
        "session ord", "concat('/src/', repo, '/') repo", "concat('Session ', session) title", "text context", "role decision",
        "'none' alternatives", "cast(null as string) consequences", "text body")
    held = t.sessions().filter("turn = 1").selectExpr(
        "repo", "format_string('decision-%s-%03d', case when session % 2 = 0 then '20240120' else '20240119' end, session) id")
    return pages.create_project_docs(new, held, "decision", AS_OF).select("id", "repo", "title", "status", F.md5("body").alias("body"))


@query
def session_rollup(t: Tables) -> DataFrame:
    return pages.session_rollup(t.sessions(), limit=500)


@query
def page_refs(t: Tables) -> DataFrame:
    return pages.body_refs(t.page_bodies()).select("name", _joined("refs").alias("refs"))


@query
def ref_mismatch(t: Tables) -> DataFrame:
    return pages.ref_mismatch(t.page_bodies()).select("name", _joined("only_body").alias("only_body"), _joined("only_refs").alias("only_refs"))


@query
def one_hop(t: Tables) -> DataFrame:
    edges = pages.reference_edges(claims=(t.claims(), "id", ["source_refs", "evidence_refs"]), pages=(t.pages(), "name", ["claim_refs"]))
    hits = t.claims().filter("status = 'verified'").select(F.col("id").alias("ref"))
    return pages.one_hop(hits, edges)


@query
def create_items(t: Tables) -> DataFrame:
    none = "cast(array() as array<string>)"
    new = t.raw("benchmark").selectExpr("item_id ord", r"split(text, '\n')[0] topic", "'reading' skill_area", f"{none} source_refs", f"{none} wiki_refs")
    existing = t.items().select(F.regexp_replace("id", "20240101", "20240120").alias("id"))
    return reviews.create_items(new, existing, AS_OF).select("id", "topic", "level", "created", "next_review")


@query
def review_schedule(t: Tables) -> DataFrame:
    return reviews.apply_reviews(t.items(), t.reviews()).select("id", "level", "next_review", "n_reviews")


# --- quotes ---------------------------------------------------------------------------------------------------------

def _bodies(t: Tables) -> DataFrame:
    return t.sources().withColumn("path", F.col("id"))


@query
def fold_text(t: Tables) -> DataFrame:
    mixed = F.concat(F.lit("“A — b”… "), "text", F.lit(" ×​·"))
    return t.documents().select("doc_id", F.md5(tx.fold_text(mixed)).alias("folded"))


@query
def check_quotes(t: Tables) -> DataFrame:
    cands = t.claims().selectExpr("id key", "coalesce(try_element_at(source_refs, 1), '') source_id",
                                  r"case when doc_id % 3 = 1 then replace(claim, ' ', '  ') else quote end quote")
    checked = quotes.check_quotes(cands, _bodies(t))
    return checked.select("key", "status", "fixed")


@query
def quote_audit(t: Tables) -> DataFrame:
    return quotes.quote_audit(t.claims(), _bodies(t)).select("id", "verdict", "short")


@query
def audit_counts(t: Tables) -> DataFrame:
    return quotes.audit_counts(t.claims())


@query
def review_marks(t: Tables) -> DataFrame:
    numbered = t.claims().withColumn("claim", F.concat("claim", F.expr("concat(' 1,', 200 + doc_id % 3, ' of ten')"))) \
        .withColumn("quote", F.expr("case when doc_id % 3 = 0 and quote <> '' then concat(quote, ' (...) twelve 1201 Ten') else quote end"))
    rows = quotes.review_marks(numbered, _bodies(t)).select("id", F.explode_outer("marks").alias("m"))
    return rows.select("id", "m.mark", "m.detail")


# --- integrity checks -----------------------------------------------------------------------------------------------

@query
def lint_status_folder(t: Tables) -> DataFrame:
    return lint.status_folder_mismatch(t.claims())


@query
def lint_missing_refs(t: Tables) -> DataFrame:
    return lint.missing_source_refs(t.claims())


@query
def lint_no_evidence(t: Tables) -> DataFrame:
    return lint.verified_without_evidence(t.claims())


@query
def lint_duplicate_claim(t: Tables) -> DataFrame:
    return lint.duplicate_claim(t.claims())


@query
def lint_orphan_wiki(t: Tables) -> DataFrame:
    return lint.orphan_wiki(t.pages())


@query
def lint_thin_source(t: Tables) -> DataFrame:
    return lint.thin_source(_bodies(t))


def _two_source_claims(t: Tables) -> DataFrame:
    """Claims whose quote may also lie in, or run across, a second source."""
    k = t.claims()
    second = F.expr("format_string('source-%s-%03d', date_format(date_add(DATE'2024-01-01', cast((doc_id + 1) % 30 as int)), 'yyyyMMdd'), (doc_id + 1) div 30 + 1)")
    return k.withColumn("source_refs", F.when(F.expr("doc_id % 4 = 2"), F.concat("source_refs", F.array(second))).otherwise(F.col("source_refs")))


@query
def lint_quote_not_in_source(t: Tables) -> DataFrame:
    return lint.quote_not_in_source(_two_source_claims(t), _bodies(t))


@query
def lint_unparseable(t: Tables) -> DataFrame:
    docs = sinks.render_claims(t.claims()).withColumn("n", F.expr("cast(substr(path, -6, 3) as int)"))
    broken = docs.withColumn("text", F.expr(r"""case n % 5 when 0 then concat('---\nfoo: [unclosed\n---\n', text)
        when 1 then regexp_replace(text, '\n---\n', '\n') when 2 then concat('x', text) else text end"""))
    ready = broken.select("path", F.lit("10_Claims").alias("root"), F.col("path").alias("doc_ord"), "text")
    return lint.unparseable(corpus.parse_frontmatter(ready))


@query
def lint_inbox(t: Tables) -> DataFrame:
    return lint.inbox(intake.classify_inbox(t.clips(), t.page_sources()))


@query
def lint_stale(t: Tables) -> DataFrame:
    return lint.stale(t.claims(), AS_OF)


@query
def lint_duplicate_id(t: Tables) -> DataFrame:
    return lint.duplicate_id(t.claim_files().select("path", "id"))


def _known(t: Tables) -> DataFrame:
    return t.claims().select("id").unionByName(t.sources().select("id"))


@query
def lint_dangling_ref(t: Tables) -> DataFrame:
    held = lint.references(t.claims()).unionByName(lint.references(t.page_bodies().withColumnRenamed("name", "id")))
    return lint.dangling_ref(held, _known(t))


@query
def lint_index_dangling(t: Tables) -> DataFrame:
    return lint.index_dangling(sinks.upsert_latest(t.index_entries()), t.claims().select("path"), "claim-index")


def _findings(t: Tables) -> DataFrame:
    return lint.lint_corpus(t.corpus(), AS_OF, t.index_documents())


@query
def lint_all(t: Tables) -> DataFrame:
    return _findings(t)


@query
def lint_summary(t: Tables) -> DataFrame:
    return lint.summary(_findings(t))


# --- state of the work ----------------------------------------------------------------------------------------------

@query
def claim_status_counts(t: Tables) -> DataFrame:
    return progress.claim_statuses(t.claim_files()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def referenced_claims(t: Tables) -> DataFrame:
    return progress.referenced_claims(t.pages())


@query
def citable_unlinked(t: Tables) -> DataFrame:
    return progress.citable_unlinked(t.claims(), t.pages())


def _state(t: Tables) -> DataFrame:
    inbox = intake.classify_inbox(t.clips(), t.page_sources())
    return progress.vault_state(inbox, t.claims(), t.pages(), t.items(), AS_OF)


@query
def vault_state(t: Tables) -> DataFrame:
    return _state(t)


@query
def stage_counts(t: Tables) -> DataFrame:
    return progress.stage_counts(_state(t))


@query
def next_step(t: Tables) -> DataFrame:
    return progress.next_step(_state(t))


# --- search ---------------------------------------------------------------------------------------------------------

@query
def tokenize(t: Tables) -> DataFrame:
    mixed = F.expr("concat(text, ' 한국어 BM25 검', doc_id, '밥 ', '색')")
    return t.documents().select("doc_id", F.md5(F.array_join(tx.tokenize(mixed), " ")).alias("tokens"), F.size(tx.tokenize(mixed)).alias("n"))


@query
def postings(t: Tables) -> DataFrame:
    return search.postings(t.documents()).select("doc_id", "term", "tf", "dl", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@query
def bm25_idf(t: Tables) -> DataFrame:
    return search.idf(search.build_index(t.documents()).written()).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_score(t: Tables) -> DataFrame:
    scores = search.bm25(t.queries(), search.build_index(t.documents()).checkpointed())
    return scores.select("query_id", "doc_id", F.round("bm", 6).alias("bm"))


@query
def embed_input(t: Tables) -> DataFrame:
    gated = gates.embed_gate(t.search_documents(), ("confidential",))
    return embedding.embed_input(gated, embedding.E5_PREFIXES[0]).select("doc_id", F.length("input").alias("chars"), "key")


@query
def embed_cache_missing(t: Tables) -> DataFrame:
    inputs = embedding.embed_input(t.documents())
    cache = inputs.filter("doc_id % 3 = 0").select(
        "key", F.expr("case when doc_id % 2 = 0 then array(1.0D) else cast(array() as array<double>) end").alias("vector"),
        F.expr("case when doc_id % 5 = 0 then 'other' else 'm' end").alias("model_tag"))
    return embedding.cache_missing(inputs, cache, "m").select("key", F.length("input").alias("chars"))


@query
def embed_dims(t: Tables) -> DataFrame:
    cut = F.expr("case when doc_id % 10 = 0 then slice(vector, 1, 32) when doc_id % 25 = 1 then slice(vector, 1, 0) else vector end")
    return embedding.embed_dims(t.vectors().withColumn("vector", cut))


def letter_embedder() -> embedding.Embed:
    """A stand-in model: how often each vowel occurs. Refuses texts of 4,000 characters and more."""
    def embed(texts: list[str]) -> list[list[float]]:
        if any(len(x) >= 4000 for x in texts):
            raise embedding.Rejected("too long")
        return [[float(x.count(c)) for c in "aeiou"] for x in texts]
    return embed


def dead_embedder() -> embedding.Embed:
    """A service that is out."""
    def embed(texts: list[str]) -> list[list[float]]:
        raise embedding.Unavailable("no answer")
    return embed


def deaf_embedder() -> embedding.Embed:
    """A service that fails before the first query."""
    letters = letter_embedder()

    def embed(texts: list[str]) -> list[list[float]]:
        if texts[0].startswith(embedding.E5_PREFIXES[1]):
            raise embedding.Unavailable("no answer")
        return letters(texts)
    return embed


@query
def embed_job(t: Tables) -> DataFrame:
    done = embedding.embed(embedding.embed_input(t.documents()).dropDuplicates(["key"]), letter_embedder)
    return done.select("key", F.array_join(F.transform("vector", lambda x: x.cast("int")), ",").alias("vector"), "embed_status")


@query
def cosine_score(t: Tables) -> DataFrame:
    return search.cosine(t.queries(), t.vectors()).select("query_id", "doc_id", F.round("cos", 6).alias("cos"))


@query
def cosine_topk(t: Tables) -> DataFrame:
    return search.nearest(t.queries(), t.vectors()).withColumn("cos", F.round("cos", 6))


@query
def competition_rank(t: Tables) -> DataFrame:
    scores = t.raw("events").selectExpr("event_type", "event_id", "round(value, 1) score")
    return search.competition_rank(scores, "event_type", "score", "rank").select("event_type", "event_id", "rank")


@query
def hybrid_topk(t: Tables) -> DataFrame:
    docs = t.search_documents()
    return search.hybrid_search(t.queries(), docs, search.build_index(docs).checkpointed(), t.vectors())


@query
def hybrid_hits(t: Tables) -> DataFrame:
    docs = t.search_documents()
    found = search.hybrid_search(t.queries(), docs, search.build_index(docs).checkpointed(), t.vectors())
    return search.search_hits(found, docs)


@query
def bm25_topk(t: Tables) -> DataFrame:
    docs = t.search_documents()
    return answer.answer(t.queries(), docs, search.build_index(docs).checkpointed(), dead_embedder, wait=0.0)


@query
def hybrid_embedded(t: Tables) -> DataFrame:
    docs = t.search_documents()
    return answer.answer(t.queries(), docs, search.build_index(docs).checkpointed(), letter_embedder, prefixes=embedding.E5_PREFIXES, blocked=("confidential",))


@query
def query_outage(t: Tables) -> DataFrame:
    docs = t.search_documents()
    return answer.answer(t.queries(), docs, search.build_index(docs).checkpointed(), deaf_embedder, prefixes=embedding.E5_PREFIXES, wait=0.0)


@query
def snapshot_diff(t: Tables) -> DataFrame:
    return search.snapshot_diff(t.snapshot_old(), t.snapshot_new())


@query
def index_refresh(t: Tables) -> DataFrame:
    changes = search.snapshot_diff(t.snapshot_old(), t.snapshot_new())
    return search.refresh_index(search.build_index(t.snapshot_old()).written(), changes, t.snapshot_new()).terms


# --- sensitivity ----------------------------------------------------------------------------------------------------

@query
def placement_leak(t: Tables) -> DataFrame:
    records = t.sources().selectExpr("id", "sensitivity", """case doc_id % 4 when 0 then '03_Resources' when 1 then '30_Learning'
        when 2 then '00_Inbox' else '01_Projects' end root""")
    return gates.placement_leak(records)


@query
def derived_leak(t: Tables) -> DataFrame:
    return gates.derived_leak(t.claims(), t.sources()).select("id", "sensitivity", "inherited")
