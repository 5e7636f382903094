"""Batches of queries against the chunk table: vector, keyword and hybrid top-k.

Scores are compared after rounding to six decimals, ties by identifier, so that the outcome does not depend on how
the chunks are partitioned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow import constants as C
from articleflow.functions import text as X
from articleflow.operators.joins import first_per_key, small_side
from articleflow.operators.keyword import KeywordIndex, indexed_topk
from articleflow.session import cut, once

DECIMALS = 6
# Queries are sent to every task in blocks of at most this many bytes; more queries mean more passes.
QUERY_BLOCK_BYTES = 64 << 20
# Cells of one query x chunk score block inside a task.
_SCORE_CELLS = 2_000_000


class _Best:
    """Running top-k per query inside one task."""

    def __init__(self, queries: int, k: int, positive: bool) -> None:
        self.k, self.positive = k, positive
        self.bar = np.full(queries, -np.inf)
        self.hits: list[list[tuple[float, object]]] = [[] for _ in range(queries)]

    def offer(self, scores: np.ndarray, ids: list) -> None:
        """``scores`` is queries x chunks. Chunks tied with the k-th best stay in until the identifier decides."""
        n = scores.shape[1]
        if n > self.k:
            kth = np.partition(scores, n - self.k, axis=1)[:, n - self.k]
            bar = np.maximum(self.bar, kth)
        else:
            bar = self.bar
        passed = scores >= bar[:, None]
        if self.positive:
            passed &= scores > 0
        for q in np.flatnonzero(passed.any(axis=1)):
            columns = np.flatnonzero(passed[q])
            found = [(-scores[q, c], ids[c]) for c in columns]
            self.hits[q] = heapq.nsmallest(self.k, self.hits[q] + found)
            if len(self.hits[q]) == self.k:
                self.bar[q] = -self.hits[q][-1][0]

    def batch(self, query_ids: pa.Array, id_type: pa.DataType) -> pa.RecordBatch:
        counts = [len(h) for h in self.hits]
        flat = [hit for hits in self.hits for hit in hits]
        return pa.RecordBatch.from_arrays(
            [
                query_ids.take(pa.array(np.repeat(np.arange(len(counts)), counts))),
                pa.array([hit[1] for hit in flat], id_type),
                pa.array([-hit[0] for hit in flat], pa.float64()),
            ],
            ["query_id", "id", "score"],
        )


def _query_blocks(queries: DataFrame, row_bytes: Column) -> list[DataFrame]:
    """Hash blocks of the queries, each small enough to send to every task."""
    size = queries.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).alias("size")).first()["size"]
    blocks = max(1, math.ceil(size / QUERY_BLOCK_BYTES))
    if blocks == 1:
        return [queries]
    queries = cut(queries)
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)]


def _in_blocks(queries: DataFrame, row_bytes: Column, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    blocks = _query_blocks(queries, row_bytes)
    if len(blocks) == 1:
        return search(blocks[0])
    return reduce(DataFrame.unionByName, [cut(search(block)) for block in blocks])


def _merge(partial: DataFrame, k: int) -> DataFrame:
    """Top-k per query over the per-task lists."""
    return first_per_key(partial, ["query_id"], [F.col("score").desc(), F.col("id").asc()], k, "rank")


def _hit_schema(queries: DataFrame, chunks: DataFrame, key: str) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", chunks.schema[key].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _of_length(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    """Rows whose vector can be compared; others (see validate_embedding_dim) are no candidates."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False)
    return batch if pc.all(fits).as_py() else batch.filter(fits)


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int = C.SEARCH_LIMIT, key: str = "chunk_key") -> DataFrame:
    """The k nearest chunks by cosine: (query_id, id, score, rank). Zero vectors score 0.

    One scan of the key and embedding columns; each task multiplies its Arrow batches with the query block and hands
    on k rows per query, so the shuffle carries tasks x queries x k rows.
    """
    schema = _hit_schema(queries, chunks, key)
    sc = chunks.sparkSession.sparkContext

    def search(block: DataFrame) -> DataFrame:
        sent = block.filter("embedding is not null").select("query_id", "embedding").toArrow()
        matrix = np.array(sent["embedding"].to_pylist(), dtype=np.float64)
        if not len(matrix):
            return chunks.sparkSession.createDataFrame([], schema)
        dim = matrix.shape[1]
        shared = sc.broadcast((sent["query_id"].combine_chunks(), _unit_rows(matrix)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, wanted = shared.value
            best = _Best(len(query_ids), k, positive=False)
            rows = max(1, _SCORE_CELLS // len(query_ids))
            id_type = None
            for batch in batches:
                id_type = batch.column(0).type
                for start in range(0, batch.num_rows, rows):
                    part = _of_length(batch.slice(start, rows), dim)
                    if not part.num_rows:
                        continue
                    flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                    vectors = _unit_rows(flat.reshape(-1, dim).astype(np.float64))
                    best.offer(np.round(wanted @ vectors.T, DECIMALS) + 0.0, part.column(0).to_pylist())
            if id_type is not None:
                yield best.batch(query_ids, id_type)

        return chunks.select(key, "embedding").mapInArrow(scan, schema)

    row_bytes = F.lit(64) + 8 * F.size("embedding")
    return _merge(_in_blocks(queries, row_bytes, search), k)


def _code_rows(tokens: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term code, tf) of the vocabulary terms in each token list, and the list lengths."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    codes = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    known = codes >= 0
    cells, tf = np.unique(rows[known] * len(vocabulary) + codes[known], return_counts=True)
    return cells // len(vocabulary), cells % len(vocabulary), tf, lengths


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int = C.SEARCH_LIMIT, key: str = "chunk_key",
                 k1: float = C.BM25_K1, b: float = C.BM25_B, index: KeywordIndex | None = None) -> DataFrame:
    """The k best chunks by BM25 over lower-cased word tokens: (query_id, id, score, rank).

    With a stored ``index`` of the chunks only the postings of the queries' terms are read (``k1`` and ``b`` are those
    of the index). Without one, two scans of the text: one counts the query terms' document frequencies, one scores. A
    chunk is scored for all queries where it lies; neither its tokens nor its (query, chunk) pairs are shuffled, only
    k rows per query and task. That keeps words found in every chunk harmless.
    """
    if index is not None:
        return indexed_topk(queries, index, k)
    schema = _hit_schema(queries, chunks, key)
    sc = chunks.sparkSession.sparkContext
    listed = chunks.select(key, X.tokens(F.col("text")).alias("tokens"))

    def search(block: DataFrame) -> DataFrame:
        terms = block.select("query_id", F.array_distinct(X.tokens(F.col("query"))).alias("terms")).toArrow()
        per_query = [row or [] for row in terms["terms"].to_pylist()]
        vocabulary = pa.array(sorted({term for row in per_query for term in row}), pa.string())
        if not len(vocabulary):
            return chunks.sparkSession.createDataFrame([], schema)
        shared_terms = sc.broadcast(vocabulary)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = shared_terms.value
            # Two more counters behind the document frequencies: chunks and tokens.
            counts = np.zeros(len(words) + 2, dtype=np.int64)
            for batch in batches:
                _, codes, _, lengths = _code_rows(batch.column(0), words)
                counts[:-2] += np.bincount(codes, minlength=len(words))
                counts[-2:] += len(lengths), lengths.sum()
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["code", "n"])

        totals = np.zeros(len(vocabulary) + 2)
        for row in listed.select("tokens").mapInArrow(tally, "code long, n long").groupBy("code").sum("n").collect():
            totals[row[0]] = row[1]
        df, n_chunks, n_tokens = totals[:-2], totals[-2], totals[-1]
        idf = np.log(1 + (n_chunks - df + 0.5) / (df + 0.5))
        mean_length = n_tokens / n_chunks if n_tokens else 1.0

        # Queries per term, as one flat list with start offsets.
        code_of = {term: i for i, term in enumerate(vocabulary.to_pylist())}
        uses = sorted((code_of[term], q) for q, row in enumerate(per_query) for term in row)
        users = np.array([q for _, q in uses])
        starts = np.searchsorted(np.array([c for c, _ in uses]), np.arange(len(vocabulary) + 1))
        shared = sc.broadcast((terms["query_id"].combine_chunks(), idf, users, starts, mean_length))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = shared_terms.value
            query_ids, weight, term_users, offsets, average = shared.value
            best = _Best(len(query_ids), k, positive=True)
            rows = max(1, _SCORE_CELLS // len(query_ids))
            id_type = None
            for batch in batches:
                id_type = batch.column(0).type
                for start in range(0, batch.num_rows, rows):
                    part = batch.slice(start, rows)
                    row, code, tf, lengths = _code_rows(part.column(1), words)
                    gain = weight[code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / average))
                    fan = offsets[code + 1] - offsets[code]
                    cell = np.repeat(np.arange(len(code)), fan)
                    nth = np.arange(len(cell)) - np.repeat(np.cumsum(fan) - fan, fan)
                    query = term_users[offsets[code[cell]] + nth]
                    n = part.num_rows
                    scores = np.bincount(query * n + row[cell], weights=gain[cell], minlength=len(query_ids) * n)
                    best.offer(np.round(scores.reshape(-1, n), DECIMALS), part.column(0).to_pylist())
            if id_type is not None:
                yield best.batch(query_ids, id_type)

        return listed.mapInArrow(scan, schema)

    row_bytes = F.lit(64) + 4 * F.octet_length("query")
    return _merge(_in_blocks(queries, row_bytes, search), k)


def rrf_fusion(dense: DataFrame, keyword: DataFrame, limit: int = C.SEARCH_LIMIT, k: int = C.RRF_K) -> DataFrame:
    """Two ranked lists merged by reciprocal rank: (query_id, id, score, dense_score, rank)."""
    lists = dense.select("query_id", "id", "rank", F.col("score").alias("dense_score")).unionByName(
        keyword.select("query_id", "id", "rank", F.lit(None).cast("double").alias("dense_score"))
    )
    fused = lists.groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), DECIMALS).alias("score"),
        F.max("dense_score").alias("dense_score"),
    )
    return _merge(fused, limit)


def hybrid_search(queries: DataFrame, chunks: DataFrame, limit: int = C.SEARCH_LIMIT, key: str = "chunk_key",
                  use_keyword: bool = True, k: int = C.RRF_K, index: KeywordIndex | None = None) -> DataFrame:
    """Vector and keyword search fused; vector search alone where there is no keyword side."""
    dense = vector_topk(queries, chunks, limit, key)
    if not use_keyword:
        return dense.withColumn("dense_score", F.col("score"))
    return rrf_fusion(dense, keyword_topk(queries, chunks, limit, key, index=index), limit, k)


def with_payload(hits: DataFrame, chunks: DataFrame, columns: list[str], key: str = "chunk_key") -> DataFrame:
    """Hits with the chunk's payload columns: one scan of those columns against the few hits."""
    payload = chunks.select(F.col(key).alias("id"), *[c for c in columns if c != key])
    return payload.join(small_side(cut(hits)), "id")


def attach_source(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """Hits with their article's source, ``Unknown Source`` where the article is missing.

    The article table is reduced to the hits' articles before the outer join.
    """
    wanted = hits.select("article_id").distinct()
    found = articles.select("article_id", "source").join(small_side(wanted), "article_id", "left_semi")
    return hits.join(found, "article_id", "left").withColumn(
        "source", F.coalesce("source", F.lit(C.DEFAULT_SOURCE))
    )


def native_score(query: Column, text: Column, dense_score: Column) -> Column:
    """Share of the query's distinct terms found in the text, plus the cosine similarity."""
    terms = F.array_distinct(X.tokens(query))
    found = F.size(F.array_intersect(terms, X.tokens(text)))
    share = F.when(F.size(terms) > 0, found / F.size(terms)).otherwise(0.0)
    return F.round(share + F.coalesce(dense_score, F.lit(0.0)), DECIMALS)


def rerank_topn(hits: DataFrame, top_n: int = C.RERANKED,
                load: Callable[[], Callable[[list[str], list[str]], np.ndarray]] | None = None,
                enabled: bool = True) -> DataFrame:
    """Rescored hits (query_id, query, id, text, dense_score, rank), best ``top_n`` per query.

    ``load`` returns a model scoring (queries, texts) pairs; without it a built-in score is used. With
    ``enabled=False`` the first ``top_n`` keep their order. Hits without text cannot be rescored and drop out.
    """
    if not enabled:
        return hits.filter(F.col("rank") <= top_n).withColumn("rerank_score", F.lit(None).cast("double"))
    usable = hits.filter(F.coalesce("text", F.lit("")) != "")
    if load is None:
        score = native_score(F.col("query"), F.col("text"), F.col("dense_score"))
    else:
        @F.pandas_udf(T.DoubleType())
        def rescore(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for queries, texts in batches:
                yield pd.Series(np.asarray(model(queries.tolist(), texts.tolist()), dtype=float))

        score = once(rescore)(F.col("query"), F.col("text"))
    scored = usable.withColumn("rerank_score", score).drop("rank")
    return first_per_key(scored, ["query_id"], [F.col("rerank_score").desc(), F.col("id").asc()], top_n, "rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of one length, in doubles; 0 where one of them is a zero vector."""
    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    def square(v: Column) -> Column:
        return total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))

    norms = F.sqrt(square(a)) * F.sqrt(square(b))
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return X.bind(norms, lambda n: F.when(n > 0, dot / n).otherwise(0.0))


def mmr_topn(candidates: DataFrame, top_n: int = C.RERANKED, relevance: float = 0.5) -> DataFrame:
    """Relevant but mutually dissimilar hits per query: (query_id, id, mmr_score, rank).

    ``candidates`` holds a query's top-k with embeddings. A group is one query's retrieved candidates (k rows), never a
    share of the chunk table; the greedy choice is a fold over ``top_n`` steps, in built-in functions. Ties go to the
    better rank.
    """
    one = F.struct("rank", "id", F.col("score").cast("double").alias("score"), "embedding")
    grouped = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("hits"))
    likeness = F.transform("hits", lambda a: F.transform("hits", lambda b: cosine(a["embedding"], b["embedding"])))
    ready = grouped.select("query_id", F.col("hits.id").alias("ids"), F.col("hits.score").alias("gain"), likeness.alias("like"))
    # State of the fold: what was chosen (number, value), and each candidate's likeness to the closest chosen one.
    start = F.struct(
        F.array().cast("array<struct<at:int,value:double>>").alias("chosen"),
        F.transform("gain", lambda g: F.lit(0.0)).alias("closest"))
    least = F.lit(float("-inf"))

    def step(state: Column, _: Column) -> Column:
        def value(gain: Column, i: Column) -> Column:
            worth = F.round(F.lit(relevance) * gain - F.lit(1 - relevance) * F.get(state["closest"], i), DECIMALS)
            return F.when(F.exists(state["chosen"], lambda c: c["at"] == i), least).otherwise(worth)

        def choose(values: Column) -> Column:
            best = F.array_max(values)
            at = (F.array_position(values, best) - 1).cast("int")
            first = F.size(state["chosen"]) == 0
            closest = F.zip_with(state["closest"], F.get("like", at),
                                 lambda old, new: F.when(first, new).otherwise(F.greatest(old, new)))
            return F.struct(
                F.concat(state["chosen"], F.array(F.struct(at.alias("at"), best.alias("value")))).alias("chosen"),
                closest.alias("closest"))

        return X.bind(F.transform("gain", value), choose)

    rounds = F.sequence(F.lit(1), F.least(F.lit(top_n), F.size("gain")))
    picked = ready.select("query_id", "ids", F.aggregate(rounds, start, step, lambda state: state["chosen"]).alias("chosen"))
    listed = picked.select("query_id", "ids", F.posexplode("chosen").alias("place", "c"))
    return listed.select("query_id", F.get("ids", F.col("c.at")).alias("id"), F.col("c.value").alias("mmr_score"),
                         (F.col("place") + 1).alias("rank"))
