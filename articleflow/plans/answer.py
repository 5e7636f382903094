"""The two answer routes over a batch of queries."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow import constants as C
from articleflow.operators import answers, contexts, hits, retrieval, routing, stats
from articleflow.operators.embedding import Embedder, embed_chunks
from articleflow.operators.joins import small_side
from articleflow.operators.keyword import KeywordIndex
from articleflow.operators.tables import drop_partitions_before, read_or_empty, within_date_filter
from articleflow.session import cut

CACHE = "cache_key string, response string, expires_at timestamp"
_STORED = f"{CACHE}, expires_day date"


@dataclass(frozen=True)
class Corpus:
    """The tables an answer draws on: chunks, articles, landed external hits per source, landed page bodies.

    ``keyword_index`` is the stored index of just these chunks, if there is one.
    """

    chunks: DataFrame
    articles: DataFrame
    external: dict[str, DataFrame]
    pages: DataFrame
    keyword_index: KeywordIndex | None = None


def recent_corpus(corpus: Corpus, date_filter: str | None, as_of: Column) -> Corpus:
    """``corpus`` with the chunks published in the last ``7d``-style period only; without a filter, as it is.

    A stored keyword index covers other chunks and weighs terms by them, so the filtered corpus has none.

    Chunks that carry ``published_date`` are filtered where they are scanned, others by their articles.
    """
    if date_filter is None:
        return corpus
    if "published_date" in corpus.chunks.columns:
        return replace(corpus, chunks=within_date_filter(corpus.chunks, date_filter, as_of), keyword_index=None)
    recent = within_date_filter(corpus.articles, date_filter, as_of).select("article_id").distinct()
    return replace(corpus, chunks=cut(corpus.chunks.join(recent, "article_id", "left_semi")), keyword_index=None)


def asked_for(external: dict[str, DataFrame], queries: DataFrame) -> dict[str, DataFrame]:
    """Landed hits of the given queries: others are dropped before hits are ranked."""
    wanted = small_side(queries.select("query_id").distinct())
    return {name: landed.join(wanted, "query_id", "left_semi") for name, landed in external.items()}


def local_hits(queries: DataFrame, corpus: Corpus, limit: int, load: Callable[[], Embedder] | None = None) -> DataFrame:
    """Hybrid hits with query, text and source; a bounded table (limit rows per query), computed once."""
    embedded = embed_chunks(queries.select("query_id", "query"), load, "query")
    found = retrieval.hybrid_search(embedded, corpus.chunks, limit, index=corpus.keyword_index)
    payload = cut(retrieval.with_payload(found, corpus.chunks, ["text", "article_id"], "chunk_key"))
    sourced = retrieval.attach_source(payload, corpus.articles)
    return cut(sourced.join(queries.select("query_id", "query"), "query_id"))


def external_contexts(routed: DataFrame, corpus: Corpus, as_of: Column) -> DataFrame:
    """Numbered contexts of the routed requests' external hits."""
    landed = asked_for(corpus.external, routed.filter("use_external"))
    merged = hits.merged_top_n(hits.external_hits(landed, C.ANSWER_CAPS, as_of))
    return contexts.web_context(hits.enrich_hits(merged, corpus.pages))


def answer_queries(queries: DataFrame, corpus: Corpus, cache: DataFrame, as_of: Column,
                   load: Callable[[], Embedder] | None = None, ranker: Callable | None = None,
                   generator: Callable | None = None, date_filter: str | None = None) -> DataFrame:
    """Requests (query_id, query) to response rows: greeting, cached, or retrieved, routed and generated.

    ``date_filter`` (``7d``, ``12h``, ``30m``) searches only chunks of that period. The cache knows no periods: use one
    cache per filter.
    """
    corpus = recent_corpus(corpus, date_filter, as_of)
    asked = routing.intent_classify(queries)
    small = answers.smalltalk_rows(queries)
    looked_up = cut(answers.cache_lookup(asked.filter("intent = 'factual'"), cache, as_of))
    missing = looked_up.filter("not hit").select("query_id", "query")
    found = local_hits(missing, corpus, C.CANDIDATES, load)
    quality = routing.meaningful_results(missing, found)
    routed = cut(routing.route_queries(missing, quality))
    result = routing.routed_results(
        routed, quality,
        contexts.build_context(found),
        contexts.build_context(retrieval.rerank_topn(found, load=ranker)),
        external_contexts(routed, corpus, as_of),
    )
    fresh = answers.answer_rows(result, generator)
    stored = F.from_json(
        "response",
        "answer string, sources array<string>, used_realtime boolean, reranked boolean, "
        "local_results_count int, query_processed string",
    )
    cached = looked_up.filter("hit").select(
        "query_id", "query", F.lit("").alias("context"), stored.alias("r")
    ).select("query_id", "query", "context", "r.*")
    return small.unionByName(fresh).unionByName(cached)


def stream_contexts(queries: DataFrame, corpus: Corpus, as_of: Column,
                    load: Callable[[], Embedder] | None = None, date_filter: str | None = None) -> DataFrame:
    """Context, source cards and prompt of the streaming route; no cache, no routing, no reranking."""
    corpus = recent_corpus(corpus, date_filter, as_of)
    factual = queries.filter(routing.intent(F.col("query")) == "factual")
    found = local_hits(factual, corpus, C.STREAM_CANDIDATES, load)
    outside = hits.external_hits(asked_for(corpus.external, factual), C.STREAM_CAPS, as_of)
    joined = contexts.parallel_context(factual, found, outside).join(factual, "query_id")
    return joined.withColumn("prompt", answers.stream_prompt(F.col("context"), F.col("query")))


def cache_path(root: str, date_filter: str | None) -> str:
    return os.path.join(root, "answer_cache", f"period={date_filter or 'all'}")


def stored_cache(spark: SparkSession, root: str, date_filter: str | None = None) -> DataFrame:
    """The answer cache below ``root``, one per date filter; empty before the first answer."""
    return read_or_empty(spark, cache_path(root, date_filter), _STORED).drop("expires_day")


def store_answers(responses: DataFrame, root: str, as_of: Column, date_filter: str | None = None) -> None:
    """Append fresh answers to the cache, partitioned by the day they expire, and delete days that have expired."""
    spark, path = responses.sparkSession, cache_path(root, date_filter)
    rows = answers.cache_put(responses, as_of).withColumn("expires_day", F.to_date("expires_at"))
    rows.write.mode("append").partitionBy("expires_day").parquet(path)
    today = spark.range(1).select(F.to_date(as_of).alias("day")).first()["day"]
    drop_partitions_before(spark, path, "expires_day", str(today))


def serve(queries: DataFrame, corpus: Corpus, root: str, as_of: Column, date_filter: str | None = None,
          **models: Callable) -> DataFrame:
    """Answer a batch from and into the stored cache, and log it; the responses as a written table.

    Fresh answers are appended to the cache below ``root``. Expired rows never count; whole days of them are deleted.
    Every request is appended to the query log with the duration of its batch. ``as_of`` should be a fixed time.
    """
    spark, start = queries.sparkSession, time.monotonic()
    cache = stored_cache(spark, root, date_filter)
    responses = cut(answer_queries(queries, corpus, cache, as_of, date_filter=date_filter, **models))
    elapsed = F.lit(round(1000 * (time.monotonic() - start)))
    # Cached answers and greetings have no context, hence only fresh answers are stored.
    store_answers(responses, root, as_of, date_filter)
    stats.query_log(responses, elapsed, as_of).write.mode("append").parquet(os.path.join(root, "query_log"))
    return responses
