"""The stored keyword and vector indexes against brute force, and what a search of them reads."""

import collections
import math
import os
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from articleflow.operators import keyword, retrieval, vector_index


@pytest.fixture
def root():
    return os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "index")


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_bm25(texts, asked, k):
    listed = [words(t) for t in texts.values()]
    mean = sum(map(len, listed)) / len(listed) or 1.0
    df = collections.Counter(w for d in listed for w in set(d))
    want = set()
    for q, query in asked:
        scored = []
        for key, doc in zip(texts, listed):
            tf = collections.Counter(doc)
            score = sum(math.log(1 + (len(listed) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (
                tf[w] + 1.2 * (0.25 + 0.75 * len(doc) / mean)) for w in set(words(query)) if tf[w])
            if score > 0:
                scored.append((-round(score, 6), key))
        want |= {(q, key, rank, -s) for rank, (s, key) in enumerate(sorted(scored)[:k], 1)}
    return want


def corpus_texts(n=900):
    """A word that stands in every chunk, frequent and rare ones, copies, empty and very long texts."""
    draw = np.random.default_rng(3)
    texts = {}
    for i in range(n):
        rare = [f"w{int(x)}" for x in draw.zipf(1.4, 12) if x < 5000]
        texts[f"k{i:04d}"] = " ".join(["the", *rare, f"Own{i % 300}"])
    for i in range(n, n + 300):
        texts[f"k{i:04d}"] = "the same copy of one text w1 w2"
    texts.update({"z1": "", "z2": None, "z3": "the " * 20_000, "z4": "ÉTÉ été w7!"})
    return texts


ASKED = [(0, "the w1 w2 own7"), (1, "Own12 own13"), (2, "nothing here"), (3, ""), (4, "the"), (5, "the été copy w3 w9 w11 own299"),
         (6, "w1 w1 w1"), (7, None)]


def hits(found):
    return {(r["query_id"], r["id"], r["rank"], r["score"]) for r in found.collect()}


@pytest.mark.parametrize("k, slice_chunks, options", [
    (5, 50_000, {}), (12, 100, {"group_postings": 500}), (3, 64, {"query_terms_limit": 4})])
def test_indexed_search_equals_brute_force(spark, root, monkeypatch, k, slice_chunks, options):
    monkeypatch.setattr(keyword, "BLOCK", 16)
    monkeypatch.setattr(keyword, "_DIRECT", 0 if k != 5 else 100_000)
    texts = corpus_texts()
    chunks = spark.createDataFrame([(key, t) for key, t in texts.items()], "chunk_key string, text string").repartition(5)
    queries = spark.createDataFrame(ASKED, "query_id int, query string")
    index = keyword.write_index(chunks, root, slice_chunks=slice_chunks, parts=7)
    want = brute_bm25(texts, ASKED, k)
    assert hits(keyword.indexed_topk(queries, index, k, **options)) == want
    assert hits(keyword.indexed_topk(queries, keyword.open_index(spark, root), k, **options)) == want
    assert hits(retrieval.keyword_topk(queries, chunks, k)) == want


def test_index_of_nothing(spark, root):
    chunks = spark.createDataFrame([], "chunk_key string, text string")
    queries = spark.createDataFrame(ASKED, "query_id int, query string")
    index = keyword.write_index(chunks, root)
    assert index.chunks == 0 and keyword.indexed_topk(queries, index).count() == 0
    assert keyword.indexed_topk(queries.limit(0), index).count() == 0


def test_a_word_of_every_chunk_is_spread_and_other_parts_stay_closed(spark, root):
    texts = corpus_texts()
    chunks = spark.createDataFrame([(key, t) for key, t in texts.items()], "chunk_key string, text string")
    index = keyword.write_index(chunks, root, slice_chunks=100, parts=16)
    lists = index.postings.filter("term = 'the'").groupBy("slice").agg(F.sum(F.size("ords")).alias("n")).collect()
    assert len(lists) == index.slices >= 12 and max(r["n"] for r in lists) <= 200
    assert sum(r["n"] for r in lists) == 1201
    # Each list is ordered by impact, and its blocks carry their highest one.
    for r in index.postings.filter("term = 'w1'").orderBy("slice", "block").collect():
        assert r["top"] == r["impacts"][0] and list(r["impacts"]) == sorted(r["impacts"], reverse=True)
    # A search opens only the parts of its words.
    part = index.postings.filter("term = 'own7'").select("part").first()[0]
    plan = index.postings.filter(F.col("part").isin([part])).select("term", "top")
    assert re.search(rf"PartitionFilters: \[[^\]]*part#\d+ = {part}\)", plan._jdf.queryExecution().executedPlan().toString())


def test_bounds_skip_blocks_without_changing_the_result(monkeypatch):
    monkeypatch.setattr(keyword, "_DIRECT", 0)
    draw = np.random.default_rng(5)
    size, k = 4000, 10
    lists, every = {}, {}
    for t, df in (("common", 4000), ("middle", 800), ("rare", 30)):
        ords = draw.choice(size, df, replace=False).astype(np.int32)
        impact = np.sort(draw.uniform(0.2, 2.2, df))[::-1]
        lists[t] = (impact[::keyword.BLOCK], ords, impact)
        every[t] = dict(zip(ords.tolist(), impact.tolist()))
    queries = [[("common", 0.01), ("rare", 6.0)], [("common", 0.2), ("middle", 1.5), ("rare", 4.0)], [("common", 1.0)]]
    touched = []

    class Counted(np.ndarray):
        def __getitem__(self, item):
            if isinstance(item, slice):
                touched.append(len(range(*item.indices(len(self)))))
            return super().__getitem__(item)

    watched = {t: (tops, ords.view(Counted), impacts) for t, (tops, ords, impacts) in lists.items()}
    found = dict((q, (ords.tolist(), scores.tolist())) for q, ords, scores in keyword._search_slice(
        watched, queries, size, k, np.zeros(3)))
    for q, terms in enumerate(queries):
        score = collections.Counter()
        for t, w in terms:
            for ord_, impact in every[t].items():
                score[ord_] += w * impact
        best = sorted(((-round(s, 6), o) for o, s in score.items()))[:k]
        assert found[q] == ([o for _, o in best], [-s for s, _ in best])
    # The one-word query reads a single block of its list.
    assert touched[-1] == keyword.BLOCK and sum(touched) < 9200


def brute_cosine(data, asked, k):
    def unit(m):
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

    scores = np.round(unit(asked) @ unit(data).T, 6) + 0.0
    return {(q, i, rank, row[i]) for q, row in enumerate(scores)
            for rank, i in enumerate(sorted(range(len(row)), key=lambda i: (-row[i], i))[:k], 1)}


@pytest.fixture(scope="module")
def clouds():
    """Vectors around 20 centres; a third are copies of one, two are zero."""
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(20, 12))
    data = centres[draw.integers(0, 20, 900)] + 0.3 * draw.normal(size=(900, 12))
    data[300:600] = data[17]
    data[[5, 6]] = 0
    asked = np.concatenate([data[::60], np.zeros((1, 12))])
    return data.astype(np.float32).astype(float), asked.astype(np.float32).astype(float)


@pytest.mark.parametrize("options", [{}, {"query_block": 4}])
def test_probed_search(spark, root, clouds, options):
    data, asked = clouds
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    odd = [(1000, None), (1001, [1.0]), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(4)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(99, [1.0]), (98, None)],
                                    "query_id int, embedding array<float>")
    index = vector_index.write_vector_index(vectors, root, "vec_id", cells=16, shard_vectors=100)
    assert index.cells.agg(F.sum("n")).first()[0] == 900
    want = brute_cosine(data, asked, 10)
    assert hits(vector_index.probed_topk(queries, index, exact=True, **options)) == want
    found = vector_index.probed_topk(queries, vector_index.open_vector_index(spark, root), **options)
    exact = retrieval.vector_topk(queries.filter("query_id < 98"), vectors.filter("vec_id < 1000"), 10, "vec_id")
    met = vector_index.recall(found, exact).agg(F.sum("met"), F.sum("wanted")).first()
    assert met[0] >= 0.9 * met[1] and met[1] == 10 * len(asked)


def test_few_vectors(spark, root):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "vec_id long, embedding array<float>")
    index = vector_index.write_vector_index(vectors, root, "vec_id")
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    assert vector_index.probed_topk(queries, index, 5).count() == 9
    empty = vector_index.write_vector_index(vectors.limit(0), root + "-empty", "vec_id")
    assert vector_index.probed_topk(queries, empty).count() == 0


def test_cells_that_cannot_help_are_not_read(spark, root):
    """Two tight clouds far apart: the bound closes the other cloud's cells."""
    rows = [(i, [1.0, i / 1000]) for i in range(50)] + [(50 + i, [i / 1000, 1.0]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = vector_index.write_vector_index(vectors, root, "vec_id", cells=2)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    ranked = vector_index._near_cells(queries, index).first()["cells"]
    assert ranked[0]["best"] > 0.99 and ranked[1]["best"] < 0.2
    assert [r["id"] for r in vector_index.probed_topk(queries, index, 3, exact=True).orderBy("rank").collect()] == [0, 1, 2]


def test_mmr_equals_the_greedy_choice(spark):
    draw = np.random.default_rng(2)
    rows, want = [], set()
    for q in range(6):
        n = (0, 1, 3, 8, 15, 15)[q]
        vectors = draw.normal(size=(n, 5))
        if n > 3:
            vectors[2] = vectors[0]
            vectors[3] = 0
        score = np.sort(np.round(draw.uniform(0, 1, n), 3))[::-1]
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
        left, closest = list(range(n)), np.zeros(n)
        for rank in range(1, min(5, n) + 1):
            value = np.round(0.5 * score - 0.5 * closest, 6)
            best = max(left, key=lambda i: (value[i], -i))
            left.remove(best)
            like = unit @ unit[best]
            closest = like if rank == 1 else np.maximum(closest, like)
            want.add((q, f"c{best}", rank))
        rows += [(q, f"c{i}", float(score[i]), i + 1, vectors[i].tolist()) for i in range(n)]
    frame = spark.createDataFrame(rows, "query_id int, id string, score double, rank int, embedding array<double>")
    found = retrieval.mmr_topn(frame.repartition(3), 5)
    assert {(r["query_id"], r["id"], r["rank"]) for r in found.collect()} == want
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_slices_are_cut_where_the_chunks_lie(spark, root):
    # Dealt by a hash of the key, slices grew beyond their bound and every term of a chunk was shuffled and sorted.
    rows = [(f"k{i % 230:03}", None if i % 50 == 0 else "" if i % 50 == 1 else f"the W{i % 7}, own{i} -") for i in range(250)]
    chunks = spark.createDataFrame(rows, "chunk_key string, text string").repartition(3)
    index = keyword.write_index(chunks, root, slice_chunks=20)
    pages = index.keys.groupBy("slice").agg(F.sum(F.size("keys")).alias("n")).collect()
    assert max(r["n"] for r in pages) <= 20 and sum(r["n"] for r in pages) == 250 and len(pages) == index.slices
    assert index.terms.filter("term = 'the'").first()["df"] == sum(bool(t) for _, t in rows)
    queries = spark.createDataFrame([(1, "w3 the"), (2, "own42 w0")], "query_id int, query string")
    want = retrieval.keyword_topk(queries, chunks, 3).select("query_id", "rank", "score")
    assert sorted(keyword.indexed_topk(queries, index, 3).select("query_id", "rank", "score").collect()) == sorted(want.collect())


def test_document_frequencies_are_counted_without_the_lists(spark, tmp_path, monkeypatch):
    """Blocks carry how many postings they hold, so that the terms' table does not read the chunk numbers."""
    rows = [(f"k{i:04}", " ".join(["all"] + ["few"] * (i % 3 == 0) + [f"w{i}"])) for i in range(600)]
    chunks = spark.createDataFrame(rows, "chunk_key string, text string").repartition(3)
    index = keyword.write_index(chunks, str(tmp_path / "i"), slice_chunks=150)
    stored = spark.read.parquet(str(tmp_path / "i" / "postings")).filter("part >= 0")
    assert stored.filter("n <> size(ords) or n is null").count() == 0
    assert {r["term"]: r["df"] for r in index.terms.filter("term in ('all', 'few', 'w7')").collect()} == {
        "all": 600, "few": 200, "w7": 1}


def test_numbered_codes():
    draw = np.random.default_rng(3)
    for codes in (draw.integers(0, 50, 2000), draw.integers(0, 1 << 40, 100), np.array([7])):
        for got, want in zip(keyword._numbered(codes), np.unique(codes, return_inverse=True)):
            assert np.array_equal(got, want)


def test_keyword_index_is_made_from_the_stored_chunks(spark, monkeypatch):
    """Documents are cut into chunks once for the chunk table and its index."""
    from catalog import retrieval as queries

    made = []
    cut_up = queries.keyed_chunks
    monkeypatch.setattr(queries, "_WRITTEN", {})
    monkeypatch.setattr(queries, "keyed_chunks", lambda *a: made.append(a) or cut_up(*a))
    stored = queries.corpus(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and stored.keyword_index.chunks == stored.chunks.count() > 0
