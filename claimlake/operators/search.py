"""Hybrid search: BM25, cosine and reciprocal rank fusion over many queries in one job."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.functions import text as tx
from claimlake.operators import scoring
from claimlake.session import cut_lineage
from claimlake.skew import skew_join

# Ranking constants.
K1, B, EPSILON = scoring.K1, scoring.B, 0.25
RRF = 60
TOP_K = 8
SNIPPET = 200

SCALE = scoring.SCALE  # scores are summed as whole multiples of 1/SCALE, so the order of the terms cannot change a sum
DIGITS = scoring.DIGITS  # scores are compared at this many decimals
MAX_TERMS = 500_000  # counted rows of (query, term) or (query, hit) that may be broadcast, some 30 MB
RANGE_DOCS = 16  # documents of about one length whose postings of a term are one block


@dataclass(frozen=True)
class Index:
    """The lexical index as tables: (doc_id, dl), (doc_id[, doc_ord], dl, term, tf), (term, df), one row of statistics, and
    (df, n_terms), how many terms are in so many documents.

    A posting carries the length of its document, so that scoring needs no join with the documents. ``counted`` is, where the
    index comes from texts, one row per document with the terms it holds.
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    spread: DataFrame
    counted: DataFrame | None = None

    def save(self, path: str) -> None:
        """Postings are laid out by term, so that a query reads only the files that can hold its terms."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        self.spread.write.mode("overwrite").parquet(f"{path}/spread")

    def checkpointed(self) -> Index:
        """The same index with each text read once and its terms counted once, for several searches in one application."""
        kept = self.written()
        spread = cut_lineage(kept.spread)
        return replace(kept, stats=cut_lineage(stats_of(sizes_of(kept.docs), spread)), spread=spread)

    def written(self) -> Index:
        """The same index with its documents and terms written, which all else is derived from."""
        kept = _from_counted(cut_lineage(self.counted)) if self.counted is not None else index_of(cut_lineage(self.docs), cut_lineage(self.postings))
        terms = cut_lineage(kept.terms)
        spread = spread_of(terms)
        return replace(kept, terms=terms, stats=stats_of(sizes_of(kept.docs), spread), spread=spread)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "terms", "stats", "spread")])


def _raw_idf(n: Column, df: Column) -> Column:
    return F.round(F.ln(n - df + 0.5) - F.ln(df + 0.5), 12)


def sizes_of(docs: DataFrame) -> DataFrame:
    """One row: how many documents there are, and their tokens together."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("total_dl"))


def spread_of(terms: DataFrame) -> DataFrame:
    return terms.groupBy("df").agg(F.count(F.lit(1)).alias("n_terms"))


def stats_of(sizes: DataFrame, spread: DataFrame) -> DataFrame:
    """One row (n_docs, total_dl, avgdl, mean_idf). A weight depends on the document frequency alone, so its mean is taken over
    frequencies, not over terms."""
    n = sizes.select("n_docs").scalar()
    mean = spread.agg((F.sum(_raw_idf(n.cast("double"), F.col("df")) * F.col("n_terms")) / F.sum("n_terms")).alias("mean_idf")).scalar()
    avgdl = F.when(F.col("n_docs") > 0, F.col("total_dl") / F.col("n_docs"))
    return sizes.select("n_docs", "total_dl", avgdl.alias("avgdl"), mean.alias("mean_idf"))


def index_of(docs: DataFrame, counts: DataFrame) -> Index:
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    spread = spread_of(terms)
    return Index(docs, counts, terms, stats_of(sizes_of(docs), spread), spread)


def build_index(docs: DataFrame) -> Index:
    """From (doc_id, text). Terms are counted inside the row that holds the document, so postings need no shuffle.

    Among the sorted tokens of a document each term is one run, and the run's length tells how often it occurs.
    """
    own = ["doc_id", *(["doc_ord"] if "doc_ord" in docs.columns else [])]
    tokens = docs.select(*own, F.sort_array(tx.tokenize(F.coalesce("text", F.lit("")))).alias("said"))
    line = F.concat(F.array_join("said", " "), F.lit(" "))
    runs = F.regexp_extract_all(line, F.lit(r"([^ ]+) (?:\1 )*+"), F.lit(0))
    return _from_counted(tokens.select(*own, F.size("said").alias("dl"), runs.alias("runs")))


def _from_counted(counted: DataFrame) -> Index:
    """From one row per document with its runs of equal tokens."""
    own = [c for c in counted.columns if c != "runs"]
    term, tf = F.substring_index("run", " ", 1), F.expr("length(run) div (length(term) + 1)")
    counts = counted.select(*own, F.explode("runs").alias("run")).withColumn("term", term).select(*own, "term", tf.alias("tf"))
    return replace(index_of(counted.select("doc_id", "dl"), counts), counted=counted)


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl, df, n_docs, avgdl)"""
    index = build_index(docs).written()
    return (index.postings.join(index.terms, "term").withColumn("s", index.stats.select(F.struct("*")).scalar())
            .select("doc_id", "term", "tf", "dl", "df", "s.n_docs", "s.avgdl"))


def idf(index: Index) -> DataFrame:
    """(term, df, idf). Terms in most documents get a small share of the mean instead of a negative weight."""
    weighed = index.terms.withColumn("s", index.stats.select(F.struct("*")).scalar())
    raw = _raw_idf(F.col("s.n_docs").cast("double"), F.col("df"))
    return weighed.select("term", "df", F.when(raw < 0, F.round(EPSILON * F.col("s.mean_idf"), 12)).otherwise(raw).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n): how often each query says each term."""
    said = queries.filter(~tx.is_blank(F.col("q"))).select("query_id", F.explode(tx.tokenize(F.col("q"))).alias("term"))
    return said.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))


def bm25(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, bm) for documents that hold a term of the query.

    The terms asked for are counted first. Up to ``MAX_TERMS`` they go to the postings, which then are only filtered and
    summed up where they lie; beyond that both sides meet by a shuffle on the term.
    """
    terms = query_terms(queries)
    send = F.broadcast if terms.count() <= MAX_TERMS else (lambda df: df)
    asked = send(idf(index).drop("df").join(send(terms), "term"))
    hits = index.postings.join(asked, "term").withColumn("avgdl", index.stats.select("avgdl").scalar())
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    part = F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    whole = F.floor(part * F.lit(SCALE) + 0.5) * F.col("n")
    sums = hits.groupBy("query_id", "doc_id").agg(F.sum(whole).alias("s"))
    return sums.select("query_id", "doc_id", F.round(F.col("s") / SCALE, DIGITS).alias("bm"))


def _said(queries: DataFrame) -> DataFrame:
    return queries.filter(~tx.is_blank(F.col("q")))


def _batches(queries: DataFrame, with_terms: bool) -> list[DataFrame]:
    """The queries in batches that a task can hold, by their number, their terms and the size of their vectors."""
    terms = F.size(tx.words(F.col("q"))) if with_terms else F.lit(0)
    dim = F.size("vector") if "vector" in queries.columns else F.lit(0)
    n, said, most = queries.agg(F.count(F.lit(1)), F.sum(terms), F.max(dim)).first()
    return scoring.batches_of(queries, said or 0, most or 0, n)


def _asked(queries: DataFrame, index: Index | None = None) -> tuple[scoring.Queries, list[str]]:
    """A batch of queries as arrays, and the terms that it asks for by their numbers."""
    vectors = "vector" in queries.columns
    own = queries.select("query_id", *([F.col("vector").cast("array<double>")] if vectors else [])).toArrow()
    ids = own["query_id"].to_pylist()
    asked = scoring.with_senses(ids, own["vector"]) if vectors and ids else scoring.Queries(ids)
    if index is None or not ids:
        return asked, []
    rows = idf(index).drop("df").join(F.broadcast(query_terms(queries)), "term").toArrow()
    number = {q: i for i, q in enumerate(ids)}
    terms, at = np.unique(np.array(rows["term"].to_pylist(), object), return_inverse=True) if rows.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
    order = np.argsort(at, kind="stable")
    weights = np.zeros(len(terms))
    weights[at] = rows["idf"].to_numpy()
    queries_of = np.array([number[q] for q in rows["query_id"].to_pylist()], np.int64)
    return replace(asked, starts=np.searchsorted(at[order], np.arange(len(terms) + 1)), queries=queries_of[order], times=rows["n"].to_numpy().astype(np.int64)[order],
                   idf=weights, avgdl=index.stats.first()["avgdl"] or 1.0), terms.tolist()


def _numbered(spark: SparkSession, name: str, values: list, number: str, kind: T.DataType) -> DataFrame:
    """(name, number) of a bounded list, marked for broadcast."""
    schema = T.StructType([T.StructField(name, kind), T.StructField(number, T.IntegerType())])
    return F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(values)], schema))


def _run(df: DataFrame, asked: scoring.Queries, kernel: Callable[[scoring.Queries, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """The kernel over the Arrow batches of each task, with the queries that every task gets once."""
    sent = df.sparkSession.sparkContext.broadcast(asked)
    return df.mapInArrow(lambda batches: kernel(sent.value, batches), schema)


def _pair(queries: DataFrame, vectors: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("doc_id", vectors.schema["doc_id"].dataType), *fields])


def cosine(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, doc_id, cos) of every stored vector for every query: one matrix product per block of vectors, a narrow pass."""
    schema = _pair(queries, vectors, T.StructField("cos", T.DoubleType()))

    def kernel(asked: scoring.Queries, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = None
        for b in scoring.pieces(batches, asked.block_rows(BLOCK_ROWS)):
            if len(asked):
                ids = pa.array(asked.ids) if ids is None else ids
                n, q = b.num_rows, len(asked)
                yield scoring.batch_of(query_id=ids.take(pa.array(np.tile(np.arange(q), n))), doc_id=b["doc_id"].take(pa.array(np.repeat(np.arange(n), q))),
                                       cos=scoring.cosines(asked, b["vector"], n).ravel())

    rows = vectors.select("doc_id", F.col("vector").cast("array<double>"))
    return reduce(DataFrame.unionByName, [_run(rows, _asked(part)[0], kernel, schema) for part in _batches(_said(queries), False)])


BLOCK_ROWS = 200_000  # rows that `cosine` hands on at once


def nearest(queries: DataFrame, vectors: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, position, doc_id, cos): the k vectors with the largest cosine per query, ties by doc_id.

    Each task keeps the best k of a query; these few meet and are cut once more. No row per vector and query leaves a task.
    """
    def kernel(asked: scoring.Queries, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = scoring.Best(len(asked), k), None
        for b in scoring.pieces(batches, asked.block_rows()):
            kind, ids = b["doc_id"].type, scoring.values(b["doc_id"])
            best.add(scoring.cosines(asked, b["vector"], b.num_rows), None, ids, ids)
        if kind is not None:
            number, cos, _, _, ids = best.cut()
            yield scoring.batch_of(query_id=pa.array(asked.ids).take(pa.array(number)), doc_id=pa.array(ids.tolist(), kind), cos=cos)

    rows = vectors.select("doc_id", F.col("vector").cast("array<double>"))
    schema = _pair(queries, vectors, T.StructField("cos", T.DoubleType()))
    found = reduce(DataFrame.unionByName, [_run(rows, _asked(part)[0], kernel, schema) for part in _batches(_said(queries), False)])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "doc_id"))
    return found.withColumn("position", place).filter(F.col("position") <= k).select("query_id", "position", "doc_id", "cos")


def competition_rank(scores: DataFrame, by: str, score: str, name: str) -> DataFrame:
    """Adds ``name``: how many rows of the same ``by`` score strictly higher.

    Equal scores are one row before anything is ranked. The distinct scores of a group are cut at their approximate
    quantiles; ranges are summed first and only then ranked inside, so no task holds a whole group.
    """
    counts = scores.groupBy(by, score).agg(F.count(F.lit(1)).alias("_n"))
    quantiles = F.percentile_approx(score, [i / 64 for i in range(1, 64)], 1000)
    cuts = counts.groupBy(by).agg(quantiles.alias("_cuts"))
    ranged = skew_join(counts, cuts, [by], "inner", [score]).withColumn("_range", F.size(F.filter("_cuts", lambda c: c >= F.col(score)))).drop("_cuts")
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(by, "_range").agg(F.sum("_n").alias("_size")).select(
        by, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(by, "_range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (ranged.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, [by, "_range"])
             .select(by, score, (F.col("_inside") + F.col("_offset")).alias(name)))
    return skew_join(scores, ranks, [by, score], "left", scores.columns)


def hybrid_search(queries: DataFrame, docs: DataFrame, index: Index, vectors: DataFrame | None, k: int = TOP_K, blocks: Blocks | None = None) -> DataFrame:
    """(query_id, position, doc_id, bm_rank, cos_rank, score) of the k best documents per query (query_id, q[, vector]).

    Score: 1 / (60 + rank by BM25) + 1 / (60 + rank by cosine), ranks from 0 over all documents, ties by ``doc_ord``.
    Without ``vectors`` the cosine is 0 for all and BM25 decides: `block_search`, where no weight is negative, over ``blocks`` if given.

    Ranks over all documents are needed for few of them. With T = 58 + 3k take the first T by (bm, cos, doc_ord) and the
    first T by (cos, bm, doc_ord). A document in neither list either has k documents before it that are at least as good
    in both scores, or both its ranks are 58 + 2k or more, which gives less than 1 / (59 + k), and the first k by BM25
    have more than that. So the k best are among these candidates, which tasks keep in bounded lists. One more pass counts, for
    the candidates' scores only, the documents above them. Per query a task sends 2T rows and then at most 4T counts,
    whatever the corpus holds. What both passes read, documents with their vectors and the asked terms they hold, is written once.
    """
    asked = _said(queries if vectors is not None else queries.drop("vector"))
    parts = [_search_batch(part, docs, index, vectors, k, blocks) for part in _batches(asked, True)]
    return reduce(DataFrame.unionByName, parts)


def _first(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_no").orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def _search_batch(queries: DataFrame, docs: DataFrame, index: Index, vectors: DataFrame | None, k: int, blocks: Blocks | None) -> DataFrame:
    asked, terms = _asked(queries, index)
    spark = docs.sparkSession
    if vectors is None and not (asked.idf < 0).any():
        ranked = block_search(asked, terms, docs, blocks or _blocks_of(index, terms), k)
    else:
        ranked = _dense_search(asked, terms, docs, index, vectors, k)
    names = _numbered(spark, "query_id", asked.ids, "query_no", queries.schema["query_id"].dataType)
    score = F.lit(1.0) / (RRF + F.col("bm_rank")) + F.lit(1.0) / (RRF + F.col("cos_rank"))
    order = Window.partitionBy("query_no").orderBy(F.desc("_score"), F.asc("doc_ord"))
    return (ranked.withColumn("_score", score).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k).join(names, "query_no")
            .select("query_id", "position", "doc_id", "bm_rank", "cos_rank", F.round("_score", 6).alias("score")))


def _blocks_of(index: Index, terms: list[str]) -> Blocks:
    """Blocks of the asked terms alone, written once, where the index has no saved ones."""
    number = _numbered(index.docs.sparkSession, "term", terms, "term_no", T.StringType())
    postings = cut_lineage(block_postings(replace(index, postings=index.postings.join(number, "term", "left_semi"))).postings)
    heads = postings.groupBy("term", "range").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    return Blocks(postings, cut_lineage(heads))  # read twice


def _kinds(docs: DataFrame, *more: str) -> T.StructType:
    kinds = {"bm": T.DoubleType(), "cos": T.DoubleType(), "range": T.LongType()}
    return T.StructType([T.StructField("query_no", T.IntegerType()), *[T.StructField(c, kinds.get(c) or docs.schema[c].dataType) for c in more]])


def _signals(asked: scoring.Queries, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | None]:
    """BM25 and cosine of a block, documents by queries."""
    at, tf = scoring.flattened(b["tf"])
    bm = scoring.lexical(asked, at, scoring.flattened(b["term_no"])[1].astype(np.int64), tf, b["dl"].fill_null(0).to_numpy()[at], b.num_rows)
    return bm, scoring.cosines(asked, b["vector"], b.num_rows) if "vector" in b.schema.names else None


def _dense_search(asked: scoring.Queries, terms: list[str], docs: DataFrame, index: Index, vectors: DataFrame | None, k: int) -> DataFrame:
    """(query_no, doc_id, doc_ord, bm_rank, cos_rank) of a batch, by two passes over all documents."""
    spark, depth, n_lists = docs.sparkSession, 58 + 3 * k, 1 if vectors is None else 2
    hits = (index.postings.join(_numbered(spark, "term", terms, "term_no", T.StringType()), "term").groupBy("doc_id")
            .agg(F.first("dl").alias("dl"), F.collect_list(F.struct("term_no", "tf")).alias("h")))
    base = docs.select("doc_id", "doc_ord").join(hits, "doc_id", "left").select("doc_id", "doc_ord", "dl", "h.term_no", "h.tf")
    if vectors is not None:
        base = base.join(vectors.select("doc_id", F.col("vector").cast("array<double>")), "doc_id", "left")
    base = cut_lineage(base)

    def candidates(asked: scoring.Queries, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, kinds = [scoring.Best(len(asked), depth) for _ in range(n_lists)], None
        for b in scoring.pieces(batches, asked.block_rows()):
            kinds = b["doc_id"].type, b["doc_ord"].type
            (bm, cos), ids, order = _signals(asked, b), scoring.values(b["doc_id"]), scoring.values(b["doc_ord"])
            lists[0].add(bm, cos, order, ids)
            if cos is not None:
                lists[1].add(cos, bm, order, ids)
        for i, best in enumerate(lists if kinds else []):
            number, first, second, order, ids = best.cut()
            scores = (first, second) if i == 0 else (second, first)
            yield scoring.batch_of(query_no=pa.array(number, pa.int32()), doc_id=pa.array(ids.tolist(), kinds[0]), doc_ord=pa.array(order.tolist(), kinds[1]), bm=scores[0], cos=scores[1])

    found = cut_lineage(_run(base, asked, candidates, _kinds(docs, "doc_id", "doc_ord", "bm", "cos")).distinct())
    sides = [_first(found, depth, F.desc(a), F.desc(b), F.asc("doc_ord")) for a, b in (("bm", "cos"), ("cos", "bm"))]
    found = cut_lineage(sides[0].unionByName(sides[1]).distinct())
    cuts = cut_lineage(found.groupBy("query_no").agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("bm", "cos")]))
    known = {r["query_no"]: (np.array(r["bm"]), np.array(r["cos"])) for r in cuts.collect()}  # 2T numbers a query of the batch at most

    def above(sent: tuple[scoring.Queries, dict], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = sent
        counts = {(q, side): np.zeros(len(cut) + 1, np.int64) for q, both in known.items() for side, cut in enumerate(both)}
        for b in scoring.pieces(batches, asked.block_rows()):
            bm, cos = _signals(asked, b)
            for (q, side), n in counts.items():
                if side == 0 or cos is not None:
                    n += np.bincount(np.searchsorted(known[q][side], (bm, cos)[side][:, q]), minlength=len(n))
        for (q, side), n in counts.items():
            at = np.flatnonzero(n[1:])
            yield scoring.batch_of(query_no=pa.array(np.full(len(at), q), pa.int32()), side=pa.array(["bm", "cos"][side:side + 1] * len(at), pa.string()), at=pa.array(at, pa.int32()), n=n[1:][at])

    counts = _run(base, (asked, known), above, "query_no int, side string, at int, n bigint").groupBy("query_no", "side", "at").agg(F.sum("n").alias("n"))
    ranks = cut_lineage(_ranks(counts, cuts))
    for c in ("bm", "cos"):
        found = found.join(ranks.filter(F.col("side") == c).select("query_no", F.col("score").alias(c), F.col("above").alias(f"{c}_rank")), ["query_no", c])
    return found


def _ranks(counts: DataFrame, cuts: DataFrame) -> DataFrame:
    """(query_no, side, score, above): how many documents score more than each score, from how many lie between it and the next."""
    flat = [cuts.select("query_no", F.lit(c).alias("side"), F.posexplode(c).alias("at", "score")) for c in ("bm", "cos")]
    upto = Window.partitionBy("query_no", "side").orderBy(F.desc("at"))
    above = F.sum(F.coalesce("n", F.lit(0))).over(upto)
    return flat[0].unionByName(flat[1]).join(counts, ["query_no", "side", "at"], "left").select("query_no", "side", "score", above.alias("above"))


@dataclass(frozen=True)
class Blocks:
    """Postings in blocks: a block is what a term has in one range of documents, and its head bounds what it can add to a score.

    A range is some `RANGE_DOCS` documents of about one length, chosen by a hash, so that the bound that max_tf and min_dl give is
    close. A hot term so has very many blocks, none of them large, and the ranges are the same for all terms.
    """

    postings: DataFrame  # (term, range, doc_id, doc_ord, tf, dl)
    heads: DataFrame  # (term, range, max_tf, min_dl)

    def save(self, path: str) -> None:
        """Both laid out by term and range, so that a query reads the heads of its terms and then the blocks that count."""
        for name in ("postings", "heads"):
            getattr(self, name).repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Blocks:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/heads"))


def block_postings(index: Index) -> Blocks:
    kind = F.floor(8 * F.log2(F.col("dl") + 1.0)).cast("int")  # some 250 kinds of lengths at most
    sizes = index.docs.groupBy(kind.alias("kind")).agg(F.ceil(F.count(F.lit(1)) / RANGE_DOCS).alias("ranges"))
    where = F.shiftleft(F.col("kind").cast("long"), 40) + F.pmod(F.xxhash64("doc_id"), F.col("ranges"))
    order = F.col("doc_ord" if "doc_ord" in index.postings.columns else "doc_id").alias("doc_ord")
    rows = index.postings.withColumn("kind", kind).join(F.broadcast(sizes), "kind").select("term", where.alias("range"), "doc_id", order, "tf", "dl")
    return Blocks(rows, rows.groupBy("term", "range").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")))


def _heads(b: pa.RecordBatch, asked: scoring.Queries) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of a batch of heads, and the bounds, ranges by queries."""
    ranges, at = np.unique(b["range"].to_numpy(), return_inverse=True)
    return ranges, scoring.bounds(asked, at, b["term_no"].to_numpy(), b["max_tf"].to_numpy(), b["min_dl"].to_numpy(), len(ranges))


@dataclass(frozen=True)
class BlockSearch:
    """A batch of queries over block postings, in steps whose rows can be counted.

    First each query's k ranges with the highest bounds are scored; its k-th best score there is what others must reach. Then the ranges
    whose bounds reach it for some query are scored, and in these only for such queries; the blocks of all others are skipped.
    """

    asked: scoring.Queries
    postings: DataFrame  # those of the asked terms: (range, term_no, doc_id, doc_ord, tf, dl)
    heads: DataFrame  # (range, term_no, max_tf, min_dl)
    docs: DataFrame
    k: int

    def _by_range(self, rows: DataFrame) -> DataFrame:
        return rows.repartition("range").sortWithinPartitions("range")

    def probes(self) -> DataFrame:
        """(range): of each query the k ranges with the highest bounds."""
        k = self.k

        def kernel(asked: scoring.Queries, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = scoring.Best(len(asked), k)
            for b in scoring.by_range(batches, asked.block_rows()):
                ranges, bounds = _heads(b, asked)
                best.add(bounds, None, ranges, ranges)
            number, bound, _, ranges, _ = best.cut()
            yield scoring.batch_of(query_no=pa.array(number, pa.int32()), range=pa.array(ranges.tolist(), pa.int64()), bm=bound)

        rows = _run(self._by_range(self.heads), self.asked, kernel, _kinds(self.docs, "range", "bm"))
        return _first(rows, k, F.desc("bm"), F.asc("range")).select("range").distinct()

    def scored(self, ranges: DataFrame, least: np.ndarray) -> DataFrame:
        """(query_no, doc_id, doc_ord, bm): of each task and query the k best above 0, where a range's bound reaches the query's least."""
        k = self.k

        def kernel(sent: tuple[scoring.Queries, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (asked, least), kinds = sent, None
            best = scoring.Best(len(asked), k)
            for b in scoring.by_range(batches, max(1, asked.block_rows() // RANGE_DOCS)):
                kinds = b["doc_id"].type, b["doc_ord"].type
                ids, order, terms = scoring.values(b["doc_id"]), scoring.values(b["doc_ord"]), b["term_no"].to_numpy().astype(np.int64)
                tf, dl = b["tf"].to_numpy(), b["dl"].to_numpy()
                _, first, doc = np.unique(ids, return_index=True, return_inverse=True)
                ranges, at = np.unique(b["range"].to_numpy(), return_inverse=True)
                _, head, block = np.unique(at * (len(asked.idf) + 1) + terms, return_index=True, return_inverse=True)
                max_tf, min_dl = np.zeros(len(head), np.int64), np.full(len(head), np.iinfo(np.int64).max)
                np.maximum.at(max_tf, block, tf)
                np.minimum.at(min_dl, block, dl)
                wanted = (scoring.bounds(asked, at[head], terms[head], max_tf, min_dl, len(ranges)) >= least)[at[first]]
                bm = scoring.lexical(asked, doc, terms, tf, dl, len(first), wanted)
                best.add(bm, None, order[first], ids[first], bm > 0)
            if kinds:
                number, bm, _, order, ids = best.cut()
                yield scoring.batch_of(query_no=pa.array(number, pa.int32()), doc_id=pa.array(ids.tolist(), kinds[0]), doc_ord=pa.array(order.tolist(), kinds[1]), bm=bm)

        rows = self.postings.join(ranges, "range", "left_semi").select("range", "term_no", "doc_id", "doc_ord", "tf", "dl")
        return _run(self._by_range(rows), (self.asked, least), kernel, _kinds(self.docs, "doc_id", "doc_ord", "bm"))

    def least(self, found: DataFrame) -> np.ndarray:
        """The k-th best score of each query so far, 0 where there are fewer."""
        kth = found.groupBy("query_no").agg(F.get(F.sort_array(F.collect_list("bm"), False), F.lit(self.k - 1)).alias("bm")).dropna()
        out = np.zeros(len(self.asked))
        for r in kth.collect():  # one number a query of the batch
            out[r["query_no"]] = r["bm"]
        return out

    def reaching(self, least: np.ndarray) -> DataFrame:
        """(range): those whose bound reaches the least score of some query."""
        def kernel(sent: tuple[scoring.Queries, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, least = sent
            for b in scoring.by_range(batches, asked.block_rows()):
                ranges, bounds = _heads(b, asked)
                yield scoring.batch_of(range=ranges[((bounds >= least) & (bounds > 10.0 ** -DIGITS)).any(axis=1)])

        return _run(self._by_range(self.heads), (self.asked, least), kernel, T.StructType([T.StructField("range", T.LongType())]))

    def found(self) -> DataFrame:
        """(query_no, doc_id, doc_ord, bm): the k best of each query whose score is above 0, ties by doc_ord."""
        probes = F.broadcast(cut_lineage(self.probes()))  # k ranges a query of the batch
        first = cut_lineage(self.scored(probes, np.zeros(len(self.asked))))
        least = self.least(first)
        rest = self.scored(self.reaching(least).join(probes, "range", "left_anti"), least)
        return _first(first.unionByName(rest), self.k, F.desc("bm"), F.asc("doc_ord"))


def block_search(asked: scoring.Queries, terms: list[str], docs: DataFrame, blocks: Blocks, k: int) -> DataFrame:
    """(query_no, doc_id, doc_ord, bm_rank, cos_rank) of the k best by BM25; where fewer have a word of the query, the first documents follow."""
    spark = docs.sparkSession
    number = _numbered(spark, "term", terms, "term_no", T.StringType())
    found = cut_lineage(BlockSearch(asked, blocks.postings.join(number, "term"), blocks.heads.join(number, "term"), docs, k).found())
    held = found.groupBy("query_no").agg(F.count(F.lit(1)).alias("n"), F.collect_list("doc_id").alias("held"))  # k at most
    first = docs.select("doc_id", "doc_ord").orderBy("doc_ord").limit(2 * k).agg(F.collect_list(F.struct("doc_id", "doc_ord"))).scalar()
    lacking = spark.range(len(asked)).select(F.col("id").cast("int").alias("query_no")).join(held, "query_no", "left").filter(F.coalesce("n", F.lit(0)) < k)
    more = lacking.select("query_no", "held", F.explode(first).alias("d")).filter(~F.coalesce(F.array_contains("held", F.col("d.doc_id")), F.lit(False)))
    rows = found.unionByName(more.select("query_no", "d.doc_id", "d.doc_ord", F.lit(0.0).alias("bm")))
    above = F.rank().over(Window.partitionBy("query_no").orderBy(F.desc("bm"))) - 1
    return _first(rows, k, F.desc("bm"), F.asc("doc_ord")).withColumns({"bm_rank": above.cast("long"), "cos_rank": F.lit(0).cast("long")})


def search_hits(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Found documents with what a reader sees of them; ``docs`` has (doc_id, ref, title, text)."""
    shown = docs.select("doc_id", "ref", "title", F.substring("text", 1, SNIPPET).alias("snippet"))
    found = cut_lineage(found)
    few = F.broadcast(found) if found.count() <= MAX_TERMS else found
    return shown.join(few, "doc_id").select("query_id", "position", "ref", "title", "score", "snippet")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, change): added, changed, deleted or same, by a digest of the text. Texts are not shuffled."""
    digest = lambda df, name: df.select("doc_id", F.sha2("text", 256).alias(name))
    both = digest(old, "was").join(digest(new, "now"), "doc_id", "full_outer")
    change = (F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted")
              .when(F.col("was") == F.col("now"), "same").otherwise("changed"))
    return both.select("doc_id", change.alias("change"))


def term_changes(added: DataFrame, removed: DataFrame) -> DataFrame:
    """(term, change): by how much postings that came and went change the terms' document frequencies; never 0."""
    signed = added.select("term", F.lit(1).alias("n")).unionByName(removed.select("term", F.lit(-1).alias("n")))
    return signed.groupBy("term").agg(F.sum("n").alias("change")).filter(F.col("change") != 0)


def moved_terms(changes: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, was, df): the changed terms with their frequencies before and after; 0 where there is none."""
    was = F.coalesce("df", F.lit(0))
    return changes.join(terms, "term", "left").select("term", was.alias("was"), (was + F.col("change")).alias("df"))


def moved_spread(spread: DataFrame, moved: DataFrame) -> DataFrame:
    """The (df, n_terms) after terms have moved from one frequency to another."""
    left, came = moved.select(F.col("was").alias("df"), F.lit(-1).alias("n_terms")), moved.select("df", F.lit(1).alias("n_terms"))
    signed = spread.select("df", "n_terms").unionByName(left).unionByName(came).filter("df > 0")
    return signed.groupBy("df").agg(F.sum("n_terms").alias("n_terms")).filter("n_terms > 0")


def moved_sizes(sizes: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    signed = sizes.select("n_docs", "total_dl").unionByName(sizes_of(added)).unionByName(sizes_of(removed).select((-F.col("n_docs")).alias("n_docs"), (-F.col("total_dl")).alias("total_dl")))
    return signed.agg(F.sum("n_docs").alias("n_docs"), F.sum("total_dl").alias("total_dl"))


def refresh_index(index: Index, changes: DataFrame, new: DataFrame) -> Index:
    """The index after a snapshot difference, by what came and what went.

    Only added and changed documents are read and tokenized. Frequencies, counts and lengths change by signed sums over their
    postings and those of what they replace; a term that is in none of these keeps its row, and nothing is counted anew.
    """
    stale = cut_lineage(changes.filter(F.col("change") != "same").select("doc_id", "change"))
    fresh = build_index(new.join(stale.filter(F.col("change") != "deleted").select("doc_id"), "doc_id", "left_semi"))
    counted = cut_lineage(fresh.counted)
    fresh, ids = _from_counted(counted), stale.select("doc_id")
    gone, gone_docs = cut_lineage(index.postings.join(ids, "doc_id", "left_semi")), index.docs.join(ids, "doc_id", "left_semi")
    moved = cut_lineage(moved_terms(term_changes(fresh.postings, gone), index.terms))
    terms = index.terms.join(moved.select("term"), "term", "left_anti").unionByName(moved.filter("df > 0").select("term", "df"))
    spread = moved_spread(index.spread, moved)
    docs = index.docs.join(ids, "doc_id", "left_anti").unionByName(fresh.docs)
    postings = index.postings.join(ids, "doc_id", "left_anti").unionByName(fresh.postings)
    return Index(docs, postings, terms, stats_of(moved_sizes(index.stats, fresh.docs, gone_docs), spread), spread)
