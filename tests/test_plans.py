"""The composed routes on a small corpus."""

import pytest
from pyspark.sql import functions as F

from articleflow.operators import answers, embedding
from articleflow.plans.answer import Corpus, answer_queries, recent_corpus, serve, stream_contexts


@pytest.fixture(scope="module")
def now(spark):
    return F.to_timestamp(F.lit("2024-01-01 00:00:00"))


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [f"Volcanic islands grow when lava number {i} meets the sea and cools down slowly" for i in range(8)]
    chunks = spark.createDataFrame(
        [(f"k{i}", t, f"a{i}") for i, t in enumerate(texts)], "chunk_key string, text string, article_id string"
    )
    articles = spark.createDataFrame([(f"a{i}", f"src{i % 2}") for i in range(6)], "article_id string, source string")
    hit = spark.createDataFrame(
        [("out", 0, "T", "http://x/0", "Pub", "short"), ("out", 1, "U", "http://x/1", None, "other")],
        "query_id string, rank int, title string, link string, source string, summary string",
    )
    pages = spark.createDataFrame([("http://x/0", "full page body")], "link string, body string")
    return Corpus(embedding.embed_chunks(chunks), articles, {"news": hit, "papers": hit}, pages)


QUERIES = [("small", "hello"), ("in", "how do volcanic islands grow"), ("out", "what is the latest on volcanic islands"),
           ("none", "recent zzz qqq xxx")]


def test_answer_route_and_cache(spark, corpus, now):
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    empty = spark.createDataFrame([], "cache_key string, response string, expires_at timestamp")
    rows = {r["query_id"]: r for r in answer_queries(asked, corpus, empty, now).collect()}
    assert rows["small"]["answer"].startswith("Hi!") and not rows["small"]["used_realtime"]
    inside = rows["in"]
    assert inside["reranked"] and not inside["used_realtime"] and inside["local_results_count"] == 8
    assert "Volcanic" in inside["answer"] and inside["context"].count("\n---\n") == 4
    assert set(inside["sources"]) <= {"src0", "src1", "Unknown Source"}
    outside = rows["out"]
    assert outside["used_realtime"] and not outside["reranked"]
    assert outside["context"].startswith("[Article 1]\nTitle: T\nSource: Pub\nLink: http://x/0\nContent: full page body...\n")
    assert outside["sources"] == ["Pub - http://x/0", "Google News - http://x/1", "arXiv Research - http://x/0",
                                  "arXiv Research - http://x/1"]
    # Routed out, but nothing was found there: the local hits serve.
    assert not rows["none"]["used_realtime"] and rows["none"]["local_results_count"] == 8

    first = spark.createDataFrame(list(rows.values()))
    again = asked.withColumn("query_id", F.concat(F.lit("again-"), "query_id"))
    cached = {r["query_id"]: r for r in answer_queries(again, corpus, answers.cache_put(first, now), now).collect()}
    for name in ("in", "out", "none", "small"):
        for column in ("answer", "sources", "used_realtime", "reranked", "local_results_count", "query_processed"):
            assert cached[f"again-{name}"][column] == rows[name][column]


def test_nothing_anywhere(spark, corpus, now):
    asked = spark.createDataFrame([("q", "what is the latest on nothing")], "query_id string, query string")
    bare = Corpus(corpus.chunks.limit(0), corpus.articles, corpus.external, corpus.pages)
    empty = spark.createDataFrame([], "cache_key string, response string, expires_at timestamp")
    row = answer_queries(asked, bare, empty, now).first()
    assert row["used_realtime"] and row["local_results_count"] == 0 and row["context"].startswith("I don't have")


def test_streaming_route(spark, corpus, now):
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    rows = {r["query_id"]: r for r in stream_contexts(asked, corpus, now).collect()}
    assert set(rows) == {"in", "out", "none"}
    local, web, papers = rows["out"]["context"].split("\n\n")
    assert local.count("\n---\n") == 7
    assert web == "Source: Pub | Content: short\nSource: Google News | Content: other"
    assert papers == "Paper: T | Summary: short\nPaper: U | Summary: other"
    assert [(c["title"], c["source"]) for c in rows["out"]["cards"]] == [
        ("T", "Pub"), ("U", "Google News"), ("T", "arXiv"), ("U", "arXiv")]
    assert rows["in"]["cards"] == [] and rows["in"]["context"].endswith("\n\n\n\n")


def test_serving_stores_answers_and_logs(spark, corpus, now, tmp_path):
    asked = spark.createDataFrame(QUERIES[:2], "query_id string, query string")
    first = {r["query_id"]: r for r in serve(asked, corpus, str(tmp_path), now).collect()}
    again = {r["query_id"]: r for r in serve(asked, corpus, str(tmp_path), now).collect()}
    assert first["in"]["context"] and not again["in"]["context"]
    assert first["in"]["answer"] == again["in"]["answer"] and first["small"]["answer"] == again["small"]["answer"]
    log = spark.read.parquet(str(tmp_path / "query_log")).collect()
    assert sorted(r["query_text"] for r in log) == sorted(2 * [q for _, q in QUERIES[:2]])
    assert all(r["response_time_ms"] > 0 for r in log)
    cached = spark.read.parquet(str(tmp_path / "answer_cache")).collect()
    assert [str(r["expires_at"]) for r in cached] == ["2024-01-01 01:00:00"]


def test_date_filter(spark, corpus, now):
    dates = F.when(F.col("article_id") < "a3", F.to_timestamp(F.lit("2023-12-31 00:00:00"))).otherwise(
        F.to_timestamp(F.lit("2023-01-01 00:00:00")))
    dated = Corpus(corpus.chunks, corpus.articles.withColumn("published_date", dates), corpus.external, corpus.pages)
    ids = lambda found: sorted(r["article_id"] for r in found.chunks.collect())
    assert ids(recent_corpus(dated, "7d", now)) == ["a0", "a1", "a2"]
    assert ids(recent_corpus(dated, "12h", now)) == []
    assert len(ids(recent_corpus(dated, None, now))) == 8
    carried = Corpus(corpus.chunks.withColumn("published_date", dates), corpus.articles, corpus.external, corpus.pages)
    assert ids(recent_corpus(carried, "7d", now)) == ["a0", "a1", "a2"]
