"""Search with an embedding service that may be out: what it answers is used, and what it does not answer is searched by words."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlake.operators import embedding, gates, search
from claimlake.session import cut_lineage


def answer(queries: DataFrame, docs: DataFrame, index: search.Index, make_embed: Callable[[], embedding.Embed], *, cache_path: str | None = None,
           tag: str = "", prefixes: tuple[str, str] = embedding.NO_PREFIXES, blocked: Sequence[str] = (), k: int = search.TOP_K, wait: float = 1.0) -> DataFrame:
    """(query_id, position, doc_id, bm_rank, cos_rank, score, degraded) for queries (query_id, q).

    Documents go to the service with the first prefix and queries with the second; texts that are barred by ``blocked``
    are found by words only. ``degraded`` says that a query was answered without the vectors it should have had: all queries if
    some document has none because of an outage, else those the service did not answer. Nothing remembers an outage: the
    next run asks for what the cache lacks, and answers in full once the service does.
    """
    said = queries.select("query_id", "q")
    ask = lambda: cut_lineage(embedding.embed_queries(said, make_embed, prefixes[1], wait))
    by_words = lambda rows, degraded: search.hybrid_search(rows, docs, index, None, k).withColumn("degraded", F.lit(degraded))
    sent = embedding.embed_input(gates.embed_gate(docs, tuple(blocked)), prefixes[0])
    if cache_path:
        vectors, asked = cut_lineage(embedding.update_cache(sent, cache_path, make_embed, tag, wait)), None
    else:
        asked = ask()  # first, as they are few: no document is asked for where no query has an answer
        if asked.filter("vector is not null").isEmpty():
            return by_words(said, not asked.isEmpty())
        once = cut_lineage(embedding.embed(sent.select("key", "input").dropDuplicates(["key"]), make_embed, wait))
        held = embedding.zero_fill(once.filter("embed_status <> 'unavailable'")).select("key", "vector")
        vectors = cut_lineage(sent.select("doc_id", "key").join(held, "key").select("doc_id", "vector"))
    whole = sent.select("doc_id").join(vectors, "doc_id", "left_anti").isEmpty()
    if not whole or vectors.isEmpty():
        return by_words(said, not whole)
    asked = ask() if asked is None else asked
    full = search.hybrid_search(asked.filter("vector is not null"), docs, index, vectors, k).withColumn("degraded", F.lit(False))
    unanswered = asked.filter("vector is null").select("query_id", "q")
    return full if unanswered.isEmpty() else full.unionByName(by_words(unanswered, True))
