"""Classification, routing, external hits, contexts, answers and the cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from articleflow import constants as C
from articleflow.operators import answers, contexts, hits, retrieval, routing
from articleflow.plans import answer
from catalog import sql as S
from catalog.registry import DOC_URL, ITEM_URL, all_queries, as_of, query, requests, table
from catalog.retrieval import corpus, hybrid_hits


def item_link():
    return F.concat(F.lit(ITEM_URL), F.col("item_id").cast("string")).alias("link")


def landed_hits(spark, sf_dir):
    """Documents as hits of the outside source given by the number in their source name, spread over the requests.

    Benchmark items are hits too, whose links no document has.
    """
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    n_requests = items.count()
    link = F.concat(F.lit(DOC_URL), F.col("doc_id").cast("string"))
    rows = docs.select(
        (F.col("doc_id") % n_requests).alias("query_id"), F.col("doc_id").alias("rank"),
        F.concat(F.lit("Hit "), F.col("doc_id").cast("string")).alias("title"), link.alias("link"),
        F.when(F.col("lang") != "en", F.col("source")).alias("source"), F.col("text").alias("summary"),
        (F.substring("source", 4, 10).cast("int") % 3).alias("kind"),
    ).unionByName(items.select(
        (F.col("item_id") % n_requests).alias("query_id"), (-1 - F.col("item_id")).alias("rank"),
        F.concat(F.lit("Hit b"), F.col("item_id").cast("string")).alias("title"), item_link(),
        F.lit(None).cast("string").alias("source"), F.col("text").alias("summary"), (F.col("item_id") % 3).alias("kind"),
    ))
    return {name: rows.filter(F.col("kind") == i).drop("kind") for i, name in enumerate(C.EXTERNAL_SOURCES)}


def landed_pages(spark, sf_dir):
    """Page bodies of all documents; those of even benchmark items were fetched empty, odd ones have none."""
    empty = table(spark, sf_dir, "benchmark").filter("item_id % 2 = 0").select(item_link(), F.lit("").alias("body"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit(DOC_URL), F.col("doc_id").cast("string")).alias("link"),
        F.concat(F.lit("Body: "), "text").alias("body"),
    ).unionByName(empty)


def answer_corpus(spark, sf_dir):
    return corpus(spark, sf_dir, landed_hits(spark, sf_dir), landed_pages(spark, sf_dir))


def merged(spark, sf_dir):
    return hits.merged_top_n(hits.external_hits(landed_hits(spark, sf_dir), C.ANSWER_CAPS, as_of()))


# ----------------------------------------------------------------------------------- classification, routing

@query("intent_classify", f"""WITH {S.LOG_QUERIES}
SELECT query_id, {S.INTENT} AS intent FROM (SELECT query_id, {S.strip('lower(query)')} AS q FROM log)""")
def intent_classify(spark, sf_dir):
    return routing.intent_classify(all_queries(spark, sf_dir)).select("query_id", "intent")


@query("fuzzy_terms", f"""WITH RECURSIVE {S.LOG_QUERIES},{S.FUZZY}
SELECT query_id, term, score >= {C.FUZZY_THRESHOLD} AS match FROM log JOIN fuzzy USING (query)""")
def fuzzy_terms(spark, sf_dir):
    return routing.fuzzy_terms(all_queries(spark, sf_dir))


@query("fuzzy_prefix_fallback", f"""WITH RECURSIVE {S.LOG_QUERIES},{S.PREFIX}
SELECT query_id, term, round(share, 6) AS score, share >= {C.FUZZY_THRESHOLD} AS match FROM (
  SELECT query_id, term, CASE WHEN contains(term, q) OR contains(q, term) THEN 1.0::DOUBLE ELSE hits / len(q) END AS share
  FROM log JOIN bare b USING (query) JOIN prefix USING (q))""")
def fuzzy_prefix_fallback(spark, sf_dir):
    return routing.fuzzy_prefix_fallback(all_queries(spark, sf_dir))


_ROUTED = f"""
lowered AS (SELECT query_id, query, lower(query) AS l, query_id LIKE 'turn-%' AS enough FROM log),
flags AS (SELECT *, {S.contains_any('l', C.FORCE_PHRASES)} AS forced, {S.contains_any('l', C.RECENCY_WORDS)} AS recent,
    NOT enough AS short, (SELECT bool_or(score >= {C.FUZZY_THRESHOLD}) FROM fuzzy f WHERE f.query = lowered.query) AS typo
  FROM lowered)"""


@query("route_queries", f"""WITH RECURSIVE {S.LOG_QUERIES},{S.FUZZY},{_ROUTED}
SELECT query_id, forced OR recent OR short OR typo AS use_external,
  concat_ws(', ', CASE WHEN forced THEN '{C.REASON_FORCED}' END, CASE WHEN recent THEN '{C.REASON_RECENCY}' END,
    CASE WHEN short THEN '{C.REASON_INSUFFICIENT}' END, CASE WHEN typo THEN '{C.REASON_FUZZY}' END) AS reasons,
  CASE WHEN contains(l, 'elsewhere') THEN 'latest news about ' ||
    {S.strip("replace(replace(query, 'elsewhere', ''), 'find it', '')")} ELSE query END AS search_query FROM flags""")
def route_queries(spark, sf_dir):
    log = all_queries(spark, sf_dir)
    # Conversation turns have local data, the short name queries have none.
    quality = log.select("query_id", (~F.col("query_id").startswith("turn-")).alias("insufficient"))
    routed = routing.route_queries(log, quality)
    return routed.select("query_id", "use_external", F.array_join("reasons", ", ").alias("reasons"), "search_query")


# -------------------------------------------------------------------------------------------- external hits

@query("external_hits", f"""WITH {S.outside(C.ANSWER_CAPS)}
SELECT query_id, source_no, rank, title, link, source, summary FROM outside""")
def external_hits(spark, sf_dir):
    return hits.external_hits(landed_hits(spark, sf_dir), C.ANSWER_CAPS, as_of())


@query("union_sources", f"""WITH {S.outside(C.STREAM_CAPS)}
SELECT source, count(*) AS n, count(DISTINCT link) AS links FROM
  (FROM outside UNION ALL FROM outside) GROUP BY 1""")
def union_sources(spark, sf_dir):
    found = hits.external_hits(landed_hits(spark, sf_dir), C.STREAM_CAPS, as_of())
    return hits.union_sources([found, found]).groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("link").alias("links")
    )


@query("merged_top_n", f"""WITH {S.outside(C.ANSWER_CAPS)},{S.ENRICHED}
SELECT query_id, CAST(ordinal AS INT) AS ordinal, link, source FROM merged""")
def merged_top_n(spark, sf_dir):
    return merged(spark, sf_dir).select("query_id", "ordinal", "link", "source")


@query("enrich_hits", f"""WITH {S.outside(C.ANSWER_CAPS)},{S.ENRICHED}
SELECT query_id, CAST(ordinal AS INT) AS ordinal, link, content FROM enriched""")
def enrich_hits(spark, sf_dir):
    enriched = hits.enrich_hits(merged(spark, sf_dir), landed_pages(spark, sf_dir))
    return enriched.select("query_id", "ordinal", "link", "content")


@query("web_context", f"""WITH {S.outside(C.ANSWER_CAPS)},{S.ENRICHED},{S.WEB}
SELECT query_id, context, array_to_string(sources, ',') AS sources FROM web""")
def web_context(spark, sf_dir):
    built = contexts.web_context(hits.enrich_hits(merged(spark, sf_dir), landed_pages(spark, sf_dir)))
    return built.select("query_id", "context", F.array_join("sources", ",").alias("sources"))


_PARALLEL = f"""
lines AS (SELECT query_id, source_no, rank, title, link, source_no = 2 AS paper,
    CASE WHEN source_no = 2 THEN '{C.PAPER_CARD_SOURCE}' ELSE source END AS label,
    CASE WHEN source_no = 2 THEN 'Paper: ' || title || ' | Summary: ' || summary
      ELSE 'Source: ' || source || ' | Content: ' || summary END AS line FROM outside),
sides AS (SELECT query_id, coalesce(string_agg(line, chr(10) ORDER BY source_no, rank) FILTER (NOT paper), '') AS web,
    coalesce(string_agg(line, chr(10) ORDER BY source_no, rank) FILTER (paper), '') AS papers,
    string_agg(title || '|' || link || '|' || label, ';' ORDER BY source_no, rank) AS cards FROM lines GROUP BY 1)"""


@query("parallel_context", f"""WITH {S.search(C.STREAM_CANDIDATES)},{S.local_context('hits', 'ctx')},
{S.outside(C.STREAM_CAPS)},{_PARALLEL}
SELECT query_id, coalesce(context, '') || repeat(chr(10), 2) || coalesce(web, '') || repeat(chr(10), 2) ||
  coalesce(papers, '') AS context, coalesce(cards, '') AS cards
FROM reqs LEFT JOIN ctx USING (query_id) LEFT JOIN sides USING (query_id)""")
def parallel_context(spark, sf_dir):
    built = answer.stream_contexts(requests(spark, sf_dir), answer_corpus(spark, sf_dir), as_of())
    card = F.transform("cards", lambda c: F.concat_ws("|", c["title"], c["url"], c["source"]))
    return built.select("query_id", "context", F.array_join(card, ";").alias("cards"))


# ------------------------------------------------------------------------------------------ answers, cache

def _routed(spark, sf_dir, found):
    asked = requests(spark, sf_dir)
    quality = routing.meaningful_results(asked, found)
    routed = routing.route_queries(asked, quality)
    outside = answer.external_contexts(routed, answer_corpus(spark, sf_dir), as_of())
    return routing.routed_results(
        routed, quality, contexts.build_context(found), contexts.build_context(retrieval.rerank_topn(found)), outside
    )


_ROUTES = f"""
lg AS (SELECT query_id, query, lower(query) AS l FROM reqs),
routed AS (SELECT query_id, query, {S.contains_any('l', C.FORCE_PHRASES)} OR {S.contains_any('l', C.RECENCY_WORDS)}
    OR insufficient OR (SELECT bool_or(score >= {C.FUZZY_THRESHOLD}) FROM fuzzy f WHERE f.query = lg.query) AS goes_out, n_hits
  FROM lg JOIN quality USING (query_id)),
results AS MATERIALIZED (SELECT r.query_id, r.query, n_hits,
    CASE WHEN goes_out AND w.query_id IS NOT NULL THEN w.context WHEN goes_out AND n_hits > 0 THEN c.context
      WHEN goes_out THEN '{C.NOTHING_FOUND_CONTEXT.replace("'", "''")}'
      WHEN n_hits = 0 THEN '{C.NO_LOCAL_CONTEXT.replace("'", "''")}' ELSE k.context END AS context,
    CASE WHEN goes_out AND w.query_id IS NOT NULL THEN w.sources WHEN goes_out AND n_hits > 0 THEN c.sources
      WHEN goes_out OR n_hits = 0 THEN [] ELSE k.sources END AS sources,
    goes_out AND (w.query_id IS NOT NULL OR n_hits = 0) AS used_realtime, NOT goes_out AND n_hits > 0 AS reranked
  FROM routed r LEFT JOIN web w USING (query_id) LEFT JOIN ctx c USING (query_id) LEFT JOIN rctx k USING (query_id))"""
_ANSWERS = f"""WITH RECURSIVE {S.search(15)},{S.QUALITY},log AS (FROM reqs),{S.FUZZY},{S.RERANKED},
{S.local_context('hits', 'ctx')},{S.local_context('reranked', 'rctx')},
{S.outside(C.ANSWER_CAPS)},{S.ENRICHED},{S.WEB},{_ROUTES}"""


@query("routed_results", f"""{_ANSWERS}
SELECT query_id, context, array_to_string(sources, ',') AS sources, used_realtime, reranked,
  n_hits AS local_results_count FROM results""")
def routed_results(spark, sf_dir):
    result = _routed(spark, sf_dir, hybrid_hits(spark, sf_dir))
    return result.select(
        "query_id", "context", F.array_join("sources", ",").alias("sources"), "used_realtime", "reranked",
        "local_results_count",
    )


@query("prompt_rows", f"""WITH {S.search(15)},{S.local_context('hits', 'ctx')},
numbered AS (SELECT query_id, query, context, array_to_string(list_transform(range(1, len(sources) + 1),
    lambda i: '[' || i || '] ' || sources[i]), chr(10)) AS numbered_sources FROM ctx JOIN reqs USING (query_id))
SELECT query_id, numbered_sources, '{answers.PROMPT_HEAD.replace("'", "''")}' || chr(10) || chr(10) || 'Passages:' || chr(10)
  || context || chr(10) || chr(10) || 'Sources:' || chr(10) || numbered_sources || chr(10) || chr(10) || 'Question:'
  || chr(10) || query || chr(10) AS prompt FROM numbered""")
def prompt_rows(spark, sf_dir):
    built = contexts.build_context(hybrid_hits(spark, sf_dir)).join(requests(spark, sf_dir), "query_id")
    return answers.prompt_rows(built).select("query_id", "numbered_sources", "prompt")


@query("answer_rows", f"""{_ANSWERS}
SELECT query_id, CASE WHEN {S.strip('context')} = '' THEN '{C.NO_CONTEXT_ANSWER.replace("'", "''")}'
  ELSE string_split(context, chr(10) || '---' || chr(10))[1] END AS answer,
  array_to_string(sources, ',') AS sources, used_realtime, reranked, n_hits AS local_results_count,
  query AS query_processed FROM results""")
def answer_rows(spark, sf_dir):
    no_cache = spark.createDataFrame([], "cache_key string, response string, expires_at timestamp")
    rows = answer.answer_queries(requests(spark, sf_dir), answer_corpus(spark, sf_dir), no_cache, as_of())
    return rows.select(
        "query_id", "answer", F.array_join("sources", ",").alias("sources"), "used_realtime", "reranked",
        "local_results_count", "query_processed",
    )


def answered_turns(spark, sf_dir):
    """Conversation turns as answered requests: user turns carry a context, others have a blank one."""
    turns = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.select(
        key.alias("query_id"), F.col("text").alias("query"), "role",
        F.when(F.col("role") == "user", F.col("text")).otherwise(" \n").alias("context"),
        F.concat(F.lit("re: "), "text").alias("answer"), F.array("role").alias("sources"),
        F.lit(False).alias("used_realtime"), F.lit(True).alias("reranked"), F.lit(1).alias("local_results_count"),
        F.col("text").alias("query_processed"),
    )


@query("cache_put", f"""SELECT '{C.CACHE_PREFIX}' || sha256(text) AS cache_key, 're: ' || text AS answer,
  '2024-02-01 01:00:00' AS expires_at FROM (SELECT DISTINCT text FROM conversations WHERE role = 'user')""")
def cache_put(spark, sf_dir):
    cached = answers.cache_put(answered_turns(spark, sf_dir), as_of())
    return cached.select(
        "cache_key", F.get_json_object("response", "$.answer").alias("answer"),
        F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"),
    )


@query("cache_lookup", """WITH live AS (SELECT DISTINCT text FROM conversations WHERE role = 'user' AND turn = 0)
SELECT conv_id || '-' || turn AS query_id, text IN (FROM live) AS hit,
  CASE WHEN text IN (FROM live) THEN 're: ' || text END AS answer FROM conversations""")
def cache_lookup(spark, sf_dir):
    turns = answered_turns(spark, sf_dir)
    opening = F.col("query_id").endswith("-0")
    # Answers to opening turns are fresh, the others expired a day ago.
    cache = answers.cache_put(turns.filter(opening), as_of()).unionByName(
        answers.cache_put(turns.filter(~opening), as_of() - F.expr("INTERVAL 1 DAY"))
    )
    found = answers.cache_lookup(turns.select("query_id", "query"), cache, as_of())
    return found.select("query_id", "hit", F.get_json_object("response", "$.answer").alias("answer"))
