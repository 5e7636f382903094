import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from articleflow.operators import contexts, retrieval


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(300, 16)).astype(np.float32)
    data[100:200] = data[50]  # a third of the chunks are copies of one
    data[250] = 0
    rows = [(f"k{i:03d}", v.tolist()) for i, v in enumerate(data)]
    asked = rng.normal(size=(7, 16)).astype(np.float32)
    asked[3] = data[50]
    chunks = spark.createDataFrame(rows, "chunk_key string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)], "query_id int, embedding array<float>")
    return data.astype(float), asked.astype(float), chunks, queries


def best(data, asked, k):
    norms = np.linalg.norm(data, axis=1)
    unit = np.divide(data, norms[:, None], out=np.zeros_like(data), where=norms[:, None] > 0)
    scores = np.round((asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ unit.T, 6)
    return {
        (q, f"k{i:03d}", rank)
        for q, row in enumerate(scores)
        for rank, i in enumerate(sorted(range(len(row)), key=lambda i: (-row[i], i))[:k], 1)
    }


@pytest.mark.parametrize("block_bytes", [1 << 26, 300])
def test_vector_topk_equals_brute_force(spark, vectors, monkeypatch, block_bytes):
    data, asked, chunks, queries = vectors
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", block_bytes)
    stray = spark.createDataFrame([("other", [1.0, 2.0])], chunks.schema)
    found = retrieval.vector_topk(queries, chunks.unionByName(stray), 12)
    assert {(r["query_id"], r["id"], r["rank"]) for r in found.collect()} == best(data, asked, 12)


def test_vector_topk_without_chunks_or_queries(spark, vectors):
    _, _, chunks, queries = vectors
    assert retrieval.vector_topk(queries, chunks.limit(0)).count() == 0
    assert retrieval.vector_topk(queries.limit(0), chunks).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 26, 100])
def test_keyword_topk_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", block_bytes)
    texts = ["the cat sat", "The cat and the dog", "a dog", "the the the", "birds, birds!", ""] * 10 + ["cat " * 50]
    asked = ["cat dog", "the birds", "nothing", "", "Cat cat"]
    words = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    mean = sum(map(len, words)) / len(words)
    want = set()
    for q, query in enumerate(asked):
        scored = []
        for i, w in enumerate(words):
            score = 0.0
            for term in set(re.findall(r"[^\W_]+", query.lower())):
                df = sum(term in d for d in words)
                tf = w.count(term)
                if tf:
                    score += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (
                        tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if score > 0:
                scored.append((-round(score, 6), f"k{i:03d}"))
        want |= {(q, key, rank, -s) for rank, (s, key) in enumerate(sorted(scored)[:8], 1)}
    chunks = spark.createDataFrame([(f"k{i:03d}", t) for i, t in enumerate(texts)], "chunk_key string, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    found = retrieval.keyword_topk(queries, chunks.repartition(3), 8)
    assert {(r["query_id"], r["id"], r["rank"], r["score"]) for r in found.collect()} == want


def test_fusion_of_one_list_keeps_its_order(spark):
    dense = spark.createDataFrame([(1, f"c{i}", 1.0 - i / 10, i + 1) for i in range(6)],
                                  "query_id int, id string, score double, rank int")
    fused = retrieval.rrf_fusion(dense, dense.limit(0), 4).orderBy("rank").collect()
    assert [r["id"] for r in fused] == ["c0", "c1", "c2", "c3"]
    both = retrieval.rrf_fusion(dense, dense.filter("id = 'c3'").withColumn("rank", F.lit(1)), 2).orderBy("rank")
    assert [r["id"] for r in both.collect()][0] == "c3"


HITS = "query_id int, query string, id string, text string, source string, dense_score double, rank int"


def hit_frame(spark):
    return spark.createDataFrame([
        (1, "red fox", "a", "a blue whale", "s1", 0.5, 1), (1, "red fox", "b", "the red fox", "s2", 0.1, 2),
        (1, "red fox", "c", "", "s3", 0.9, 3), (1, "red fox", "d", "a fox", "s1", None, 4),
    ], HITS)


def test_rerank(spark):
    frame = hit_frame(spark)
    native = retrieval.rerank_topn(frame, 2).orderBy("rank").collect()
    assert [r["id"] for r in native] == ["b", "a"] or [r["id"] for r in native] == ["b", "d"]
    off = retrieval.rerank_topn(frame, 2, enabled=False).orderBy("rank").collect()
    assert [r["id"] for r in off] == ["a", "b"]

    def load():
        return lambda queries, texts: np.array([len(t) for t in texts])

    model = retrieval.rerank_topn(frame, 3, load).orderBy("rank").collect()
    assert [r["id"] for r in model] == ["a", "b", "d"]


def test_contexts(spark):
    frame = hit_frame(spark)
    row = contexts.build_context(frame).first()
    assert row["context"] == "a blue whale\n---\nthe red fox\n---\na fox"
    assert row["sources"] == ["s1", "s2"]
    assert contexts.distinct_sources(frame).first()["sources"] == ["s1", "s2", "s3"]


def test_mmr_prefers_different_hits(spark):
    rows = [(1, "a", 0.9, 1, [1.0, 0.0]), (1, "b", 0.89, 2, [1.0, 0.01]), (1, "c", 0.5, 3, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "query_id int, id string, score double, rank int, embedding array<float>")
    assert [r["id"] for r in retrieval.mmr_topn(frame, 2).orderBy("rank").collect()] == ["a", "c"]
    assert [r["id"] for r in retrieval.mmr_topn(frame, 5, 1.0).orderBy("rank").collect()] == ["a", "b", "c"]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, vectors, tmp_path):
    _, _, chunks, queries = vectors
    path = str(tmp_path / "chunks")
    chunks.withColumn("text", F.lit("some text")).write.parquet(path)
    plan = plan_of(retrieval.vector_topk(queries, spark.read.parquet(path)))
    assert "ReadSchema: struct<chunk_key:string,embedding:array<float>>" in plan
    assert "Partial" in plan and plan.count("Exchange") == 1
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
