"""Retrieval over the documents' chunks and over the given vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from articleflow import constants as C
from articleflow.operators import contexts, embedding, keyword, retrieval, vector_index
from articleflow.plans.answer import Corpus, local_hits
from articleflow.session import scratch
from catalog import sql as S
from catalog.documents import keyed_chunks, stored_chunks
from catalog.registry import doc_articles, query, requests, table


# Tables that were written in this application, by kind and input: as after an ingest, the chunk table and its index are
# written once and searched many times.
_WRITTEN = {}


def written(kind, spark, sf_dir, write):
    name = (kind, spark.sparkContext.applicationId, sf_dir)
    if name not in _WRITTEN:
        _WRITTEN[name] = write(scratch(spark, kind))
    return _WRITTEN[name]


def stored_keyword_index(spark, sf_dir, chunks=None):
    """The index of all chunks, made from the chunk table where that is stored."""
    return written("keyword-index", spark, sf_dir, lambda path: keyword.write_index(
        keyed_chunks(spark, sf_dir) if chunks is None else chunks, path))


def stored_vector_index(spark, sf_dir):
    return written("vector-index", spark, sf_dir, lambda path: vector_index.write_vector_index(
        table(spark, sf_dir, "embeddings"), path, "vec_id"))


def stored_embedded_chunks(spark, sf_dir):
    def write(path):
        columns = ("chunk_key", "chunk_id", "text", "article_id", "url")
        # A dictionary of a vector's numbers costs more time than the disk it spares.
        embedding.embed_chunks(keyed_chunks(spark, sf_dir).select(*columns)).write.option(
            "parquet.enable.dictionary#embedding.list.element", "false").parquet(path)
        return path

    return spark.read.parquet(written("chunks", spark, sf_dir, write))


def corpus(spark, sf_dir, external=None, pages=None):
    """Stored chunk table with embeddings over all documents, and its keyword index."""
    chunks = stored_embedded_chunks(spark, sf_dir)
    return Corpus(chunks, doc_articles(spark, sf_dir), external or {}, pages, stored_keyword_index(spark, sf_dir, chunks))


def embedded_requests(spark, sf_dir):
    return embedding.embed_chunks(requests(spark, sf_dir), None, "query")


def hybrid_hits(spark, sf_dir, limit=C.CANDIDATES):
    return local_hits(requests(spark, sf_dir), corpus(spark, sf_dir), limit)


_MEANS = """
dims AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
centroids AS (SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY 1)"""


def _nearest(k):
    return f"""{_MEANS},
nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT c.label AS query_id, vec_id AS id, round(list_cosine_similarity(c.c, embedding::DOUBLE[]), 6) AS score
  FROM centroids c, embeddings)) WHERE rank <= {k})"""


_CENTROIDS = _nearest(10)


def label_means(spark, sf_dir):
    """Each label's mean vector as a query."""
    return (
        table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
        .groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("c"))
        .select(F.col("label").alias("query_id"), F.col("c.m").alias("embedding"))
    )


def centroid_hits(spark, sf_dir, k=C.SEARCH_LIMIT):
    """The vectors nearest to each label's mean vector."""
    return retrieval.vector_topk(label_means(spark, sf_dir), table(spark, sf_dir, "embeddings"), k, "vec_id")


@query("vector_topk", f"WITH {_CENTROIDS} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM nearest")
def vector_topk(spark, sf_dir):
    return centroid_hits(spark, sf_dir)


@query("vector_index_topk")
def vector_index_topk(spark, sf_dir):
    """Each twentieth vector's nearest ones by probing a share of the cells."""
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.probed_topk(asked, stored_vector_index(spark, sf_dir))


@query("vector_index_exact", f"WITH {_CENTROIDS} SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM nearest")
def vector_index_exact(spark, sf_dir):
    return vector_index.probed_topk(label_means(spark, sf_dir), stored_vector_index(spark, sf_dir), exact=True)


@query("keyword_index", f"""WITH {S.DOCS},{S.CHUNKS},
ct AS (SELECT chunk_key, unnest({S.tokens('text')}) AS term, len({S.tokens('text')}) AS chunk_len FROM chunks)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(sum(tf * chunk_len) AS BIGINT) AS weighted FROM
  (SELECT term, chunk_key, chunk_len, count(*) AS tf FROM ct GROUP BY ALL) GROUP BY 1""")
def keyword_index(spark, sf_dir):
    postings = keyword.keyword_postings(keyed_chunks(spark, sf_dir))
    return postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum(F.col("tf") * F.col("chunk_len")).alias("weighted")
    )


@query("keyword_topk", f"""WITH {S.DOCS},{S.CHUNKS},{S.REQUESTS},{S.bm25(10)}
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM keyword""")
def keyword_topk(spark, sf_dir):
    return keyword.indexed_topk(requests(spark, sf_dir), stored_keyword_index(spark, sf_dir))


@query("keyword_scan_topk", f"""WITH {S.DOCS},{S.CHUNKS},{S.REQUESTS},{S.bm25(10)}
SELECT query_id, id, score, CAST(rank AS INT) AS rank FROM keyword""")
def keyword_scan_topk(spark, sf_dir):
    return retrieval.keyword_topk(requests(spark, sf_dir), stored_chunks(spark, sf_dir))


@query("rrf_fusion", f"""WITH {S.DOCS},{S.CHUNKS},{S.REQUESTS},{S.hybrid(10)}
SELECT query_id, id, score, dense_score, CAST(rank AS INT) AS rank FROM hybrid""")
def rrf_fusion(spark, sf_dir):
    asked, stored = embedded_requests(spark, sf_dir), corpus(spark, sf_dir)
    return retrieval.rrf_fusion(
        retrieval.vector_topk(asked, stored.chunks),
        retrieval.keyword_topk(asked, stored.chunks, index=stored.keyword_index),
    )


@query("hybrid_search", f"""WITH {S.search(15)}
SELECT query_id, id, score, CAST(rank AS INT) AS rank, text FROM hits""")
def hybrid_search(spark, sf_dir):
    return hybrid_hits(spark, sf_dir).select("query_id", "id", "score", "rank", "text")


@query("attach_source", """SELECT vec_id, coalesce(d.source, 'Unknown Source') AS source, label FROM embeddings
LEFT JOIN documents d ON d.doc_id = vec_id
UNION ALL SELECT -1 - vec_id, 'Unknown Source', label FROM embeddings""")
def attach_source(spark, sf_dir):
    # A second vector of each belongs to an article that no table has.
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    vectors = stored.unionByName(stored.withColumn("vec_id", -1 - F.col("vec_id")))
    vectors = vectors.withColumn("article_id", F.col("vec_id"))
    articles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "source")
    return retrieval.attach_source(vectors, articles).select("vec_id", "source", "label")


@query("rerank_topn", f"""WITH {S.search(15)},{S.RERANKED}
SELECT query_id, id, rerank_score, CAST(rank AS INT) AS rank FROM reranked""")
def rerank_topn(spark, sf_dir):
    return retrieval.rerank_topn(hybrid_hits(spark, sf_dir)).select("query_id", "id", "rerank_score", "rank")


def _mmr_rounds(n, relevance=0.5):
    """The greedy choice, one round after the other: each candidate's value, the best one, the new closeness."""
    parts, start = [], "left0 AS (SELECT query_id, rank, id, score, 0.0::DOUBLE AS closest FROM cands)"
    for r in range(1, n + 1):
        parts.append(f"""
pick{r} AS MATERIALIZED (SELECT query_id, rank, id, value AS mmr_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY value DESC, rank) AS n FROM (SELECT *, round({relevance} * score - {1 - relevance} * closest, 6) AS value
    FROM left{r - 1})) WHERE n = 1),
left{r} AS MATERIALIZED (SELECT l.query_id, l.rank, l.id, l.score,
    {"s.likeness" if r == 1 else "greatest(l.closest, s.likeness)"} AS closest
  FROM left{r - 1} l JOIN pick{r} p USING (query_id) JOIN sims s ON s.query_id = l.query_id AND s.a = l.rank AND s.b = p.rank
  WHERE l.rank <> p.rank)""")
    picks = " UNION ALL ".join(f"SELECT query_id, id, mmr_score, {r} AS rank FROM pick{r}" for r in range(1, n + 1))
    return f"{start},{','.join(parts)}, picked AS ({picks})"


@query("mmr_topn", f"""WITH {_nearest(C.CANDIDATES)},
cands AS MATERIALIZED (SELECT query_id, n.id, score, rank, embedding::DOUBLE[] AS v FROM nearest n JOIN embeddings e ON e.vec_id = n.id),
sims AS MATERIALIZED (SELECT a.query_id, a.rank AS a, b.rank AS b, list_cosine_similarity(a.v, b.v) AS likeness
  FROM cands a JOIN cands b USING (query_id)),
{_mmr_rounds(C.RERANKED)}
SELECT query_id, id, mmr_score, CAST(rank AS INT) AS rank FROM picked""")
def mmr_topn(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.mmr_topn(centroid_hits(spark, sf_dir, C.CANDIDATES).join(vectors, "id"))


@query("meaningful_results", f"""WITH {S.search(15)},{S.QUALITY} SELECT * FROM quality""")
def meaningful_results(spark, sf_dir):
    from articleflow.operators.routing import meaningful_results as check

    return check(requests(spark, sf_dir), hybrid_hits(spark, sf_dir))


@query("distinct_sources", f"""WITH {S.search(15)},{S.local_context('hits', 'ctx')}
SELECT query_id, array_to_string(sources, ',') AS sources FROM ctx""")
def distinct_sources(spark, sf_dir):
    found = contexts.distinct_sources(hybrid_hits(spark, sf_dir))
    return found.select("query_id", F.array_join("sources", ",").alias("sources"))


@query("build_context", f"""WITH {S.search(15)},{S.local_context('hits', 'ctx')}
SELECT query_id, context, array_to_string(sources, ',') AS sources FROM ctx""")
def build_context(spark, sf_dir):
    found = contexts.build_context(hybrid_hits(spark, sf_dir))
    return found.select("query_id", "context", F.array_join("sources", ",").alias("sources"))
