"""Ledger tables derived from the given parquet tables. Every row of the inputs is used."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.schema import CLAIM_TYPES, PAGE_TYPES
from claimlake.sources import sinks

AS_OF = "2024-01-20"
DAY = "date_add(DATE'2024-01-01', cast(doc_id % 30 as int))"
SEQ = "doc_id div 30 + 1"


def _array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


class Tables:
    """The logical tables over one data folder; each method builds a plan and reads nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self) -> DataFrame:
        return sinks.read_spread(self.spark, f"{self.folder}/documents.parquet", "doc_id")

    def html(self) -> DataFrame:
        return sinks.read_spread(self.spark, f"{self.folder}/pages.parquet", "page_id")

    def documents(self) -> DataFrame:
        return self.texts().select("doc_id", "text")

    def sources(self) -> DataFrame:
        return self.texts().selectExpr(
            "doc_id", f"format_string('source-%s-%03d', date_format({DAY}, 'yyyyMMdd'), {SEQ}) id", "source origin",
            f"{DAY} captured_at",
            "case doc_id % 3 when 0 then 'personal' when 1 then 'work' else 'confidential' end sensitivity",
            "concat('https://', source, '.example.org/', doc_id) url", r"concat('## Raw\n\n', text) body")

    def claims(self) -> DataFrame:
        labels = self.raw("labels")
        head = self.raw("documents").select("doc_id", F.split("text", "\n", 4).alias("lines"))
        third = F.coalesce(F.try_element_at("lines", F.lit(3)), F.lit(""))
        b = head.select("doc_id", F.element_at("lines", 1).alias("l1"), third.alias("l3")).join(labels, "doc_id", "left")
        c = b.selectExpr(
            "*", f"format_string('source-%s-%03d', date_format({DAY}, 'yyyyMMdd'), {SEQ}) sid", f"{DAY} captured_at",
            """case when quality is null then case doc_id % 4 when 0 then 'accepted_for_now' when 1 then 'partially_true'
                 else 'unverified' end
               when quality = 1 and toxic = 0 then 'verified' when quality = 1 then 'disputed'
               when toxic = 0 then 'attributed' else 'rejected' end status""")
        c = c.withColumn("folder", F.when(F.expr("doc_id % 17 = 0"), "rejected").otherwise(sinks.status_folder(F.col("status"))))
        return c.selectExpr(
            "doc_id", "replace(sid, 'source', 'claim') id", "status", "folder", "l1 claim",
            "case when doc_id % 5 = 0 then concat('spk', doc_id % 2) end speaker",
            """case when doc_id % 11 = 0 then cast(array() as array<string>)
                 when doc_id % 13 = 0 then array('source-20990101-001') else array(sid) end source_refs""",
            """case when status = 'verified' and doc_id % 2 = 0 then array('') when status = 'verified' then array('labels')
                 else cast(array() as array<string>) end evidence_refs""",
            """case when doc_id % 6 = 0 then '' when doc_id % 7 = 0 then concat(l1, ' drifted')
                 when doc_id % 5 = 0 and l3 <> '' then concat(l1, ' (...) ', l3) else l1 end quote""",
            "case when doc_id % 9 = 0 then date_add(captured_at, 10) end review_after",
            f"element_at({_array(CLAIM_TYPES)}, cast(doc_id % 8 as int) + 1) claim_type",
            "case doc_id % 4 when 0 then 'attributed' when 1 then '' else 'verified' end proposed_status",
            "case doc_id % 2 when 0 then 'personal' else 'work' end sensitivity", "captured_at created",
            "concat('10_Claims/', folder, '/', replace(sid, 'source', 'claim'), '.md') path")

    def pages(self) -> DataFrame:
        refs = (self.claims().selectExpr("doc_id div 4 conv_id", "id").filter("conv_id % 4 <> 0")
                .groupBy("conv_id").agg(F.sort_array(F.collect_list("id")).alias("claim_refs")))
        names = self.raw("conversations").select("conv_id").distinct()
        return names.join(refs, "conv_id", "left").selectExpr(
            "conv_id", "concat('conv ', conv_id) name",
            f"element_at({_array(PAGE_TYPES)}, cast(conv_id % 5 as int) + 1) type",
            "coalesce(claim_refs, cast(array() as array<string>)) claim_refs")

    def page_bodies(self) -> DataFrame:
        return self.pages().selectExpr(
            "name", "type", "claim_refs",
            """case conv_id % 3 when 1 then array_join(slice(claim_refs, 2, size(claim_refs)), ' ')
                 when 2 then concat(array_join(claim_refs, ' '), ' claim-20240101-001')
                 else array_join(claim_refs, ' ') end body""")

    def clips(self) -> DataFrame:
        return self.html().selectExpr("page_id", "concat('00_Inbox/', page_id, '.md') path", "url", "html text")

    def page_sources(self) -> DataFrame:
        return self.html().filter("page_id % 3 < 2").selectExpr(
            "page_id", "format_string('source-20240201-%03d', page_id) id", "url",
            r"concat('## Raw\n\n', case when page_id % 3 = 0 then html else 'older capture' end) body")

    def reviews(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "format_string('learning-20240101-%03d', user_id) learning_id", "event_id seq", "cast(ts as date) date",
            "event_type not in ('error', 'view') passed")

    def items(self) -> DataFrame:
        ids = self.raw("events").select("user_id").distinct()
        return ids.selectExpr(
            "user_id", "format_string('learning-20240101-%03d', user_id) id", "concat('topic ', user_id) topic",
            "case user_id % 7 when 0 then null when 1 then 'seen' when 2 then 'odd' else 'unknown' end level",
            "date_add(DATE'2024-01-01', cast(user_id % 40 as int)) next_review")

    def claim_files(self) -> DataFrame:
        k = self.claims()
        copy = k.filter("doc_id % 29 = 0 and folder <> 'outdated'").withColumn("folder", F.lit("outdated"))
        both = k.unionByName(copy)
        return both.withColumn("path", F.concat(F.lit("10_Claims/"), "folder", F.lit("/"), "id", F.lit(".md")))

    def index_entries(self) -> DataFrame:
        k = self.claims().withColumn("id", F.expr(
            "case when doc_id % 23 = 0 then concat('claim-20990101-', format_string('%03d', doc_id)) else id end"))
        first = k.selectExpr("id", "1L ord", "concat(left(claim, 60), ' - unverified') line")
        second = k.filter("doc_id % 2 = 0").selectExpr("id", "2L ord", r"concat(left(claim, 60), ' -\n ', status) line")
        return first.unionByName(second)

    def corpus(self) -> DataFrame:
        """The records of claims with their copies, sources, pages and clips as parsed documents; some claim files are broken."""
        def parsed(df: DataFrame, root: str, path: str, meta: dict[str, str], lists: dict[str, str], body: Column | str, text: str = "cast(null as string)") -> DataFrame:
            # literal maps and roots, so that a check on one kind of record reads that kind alone
            entries = lambda d, kind: F.create_map(*[c for k, e in d.items() for c in (F.lit(k), F.expr(f"cast({e} as {kind})"))]).cast(f"map<string,{kind}>")
            return df.select(F.expr(path).alias("path"), F.lit(root).alias("root"), F.expr(text).alias("text"), entries(meta, "string").alias("meta"),
                             entries(lists, "array<string>").alias("lists"), (F.expr(body) if isinstance(body, str) else body).alias("body"), F.lit(False).alias("corrupt"))

        fields = ("id", "status", "claim", "speaker", "review_after", "sensitivity")
        claims = parsed(self.claim_files(), "10_Claims", "path", {"type": "'claim'", **{f: f for f in fields}}, {f: f for f in ("source_refs", "evidence_refs")},
                        sinks.claim_body(F.col("claim"), F.col("quote")))
        broken = parsed(self.claims().filter("doc_id % 50 = 7"), "10_Claims", "concat('10_Claims/pending/broken-', doc_id, '.md')", {}, {}, "'---'").withColumn("corrupt", F.lit(True))
        source = {"type": "'source'", "id": "id", "url": "url"}
        sources = self.sources().select("id", "url", "body").unionByName(self.page_sources().select("id", "url", "body"))
        pages = parsed(self.page_bodies(), "03_Resources", "concat('03_Resources/', name, '.md')", {"type": "type", "name": "name"}, {"claim_refs": "claim_refs"}, "body")
        clips = parsed(self.clips(), "00_Inbox", "path", {"url": "url"}, {}, "text", "text")
        parts = (claims, broken, parsed(sources, "00_Inbox", "concat('00_Inbox/raw/', id, '.md')", source, {}, "body"), pages, clips)
        return reduce(DataFrame.unionByName, parts)

    def index_documents(self) -> DataFrame:
        lines = sinks.upsert_latest(self.index_entries())
        return lines.select(F.lit("06_Metadata/indexes/claim-index.md").alias("path"), F.concat(F.lit("- ["), "id", F.lit("] "), "line").alias("text"))

    def snapshot_old(self) -> DataFrame:
        return self.documents()

    def snapshot_new(self) -> DataFrame:
        d = self.documents()
        kept = d.filter("doc_id % 10 <> 1").selectExpr(
            "doc_id", "case when doc_id % 10 = 0 then concat(text, ' edited') else text end text")
        return kept.unionByName(d.filter("doc_id % 50 = 0").selectExpr("doc_id + 1000000 doc_id", "text"))

    def search_documents(self) -> DataFrame:
        """Search rows in document order."""
        return self.texts().selectExpr(
            "doc_id", "doc_id doc_ord", "concat('doc-', doc_id) ref", "split(text, '\\n')[0] title", "text",
            "case doc_id % 3 when 0 then 'personal' when 1 then 'work' else 'confidential' end sensitivity",
            "doc_id % 8 = 0 pre_ingest")

    def queries(self) -> DataFrame:
        """One query per benchmark passage: its first line; its vector is the embedding of the same number."""
        q = self.raw("benchmark").selectExpr("item_id query_id", r"split(text, '\n')[0] q")
        v = self.raw("embeddings").selectExpr("vec_id query_id", "embedding vector")
        return q.join(v, "query_id", "left")

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").selectExpr("vec_id doc_id", "embedding vector")

    def commands(self) -> DataFrame:
        rank = self.raw("events").selectExpr("*", "event_id + 1 seq")
        e = F.expr
        return rank.select(
            e("format_string('claim-20240101-%03d', user_id)").alias("claim_id"), "seq", "event_id",
            e("""case event_type when 'signup' then 'create' when 'view' then 'set_status' when 'click' then
                 case when event_id % 3 = 0 then 'update_quote' else 'update_text' end
                 when 'purchase' then 'promote' else 'set_status' end""").alias("cmd"),
            e("""case event_type when 'view' then case when event_id % 4 = 0 then 'unverified' else 'accepted_for_now' end
                 when 'error' then 'rejected' when 'purchase' then 'verified' end""").alias("target"),
            e("""case when event_type = 'purchase' and event_id % 2 = 0 then array(props)
                 when event_type = 'purchase' then array('') else cast(array() as array<string>) end""").alias("evidence"),
            e("case when event_type in ('signup', 'click') then concat('text ', event_id % 7) end").alias("new_text"),
            e("case when event_type = 'click' then concat('quote ', event_id % 5) end").alias("new_quote"),
            e("case when event_type = 'click' and event_id % 5 = 0 then '' else 'fix' end").alias("reason"),
            e("case when event_type = 'error' then 'claim-20240102-001' end").alias("superseded_by"),
            e("case when event_id % 19 = 0 then 'rumour' else 'observation' end").alias("claim_type"),
            e("'work'").alias("sensitivity"), e("cast(null as string)").alias("speaker"),
            e("cast(array() as array<string>)").alias("source_refs"), e("''").alias("proposed_status"),
            e("cast(ts as date)").alias("date"))

    def sessions(self) -> DataFrame:
        return self.raw("conversations").selectExpr(
            "conv_id session", "concat('Repo ', conv_id % 5) repo", "turn", "role", "text")


