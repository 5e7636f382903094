import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from articleflow.constants import CHUNK_SEPARATORS
from articleflow.operators import chunking, embedding


def split(text, size=20, overlap=5):
    return chunking.split_spans(text, size, overlap, CHUNK_SEPARATORS)


def test_short_text_is_one_chunk():
    assert split("one two") == ["one two"]
    assert split("") == [] and split(" \n ") == []


def test_words_are_packed_with_overlap():
    assert split("aaaa bbbb cccc dddd eeee ffff") == ["aaaa bbbb cccc dddd", "dddd eeee ffff"]


def test_paragraphs_come_first():
    assert split("first paragraph\n\nsecond one here\n\nthird") == ["first paragraph", "second one here", "third"]


def test_long_words_are_cut_by_characters():
    text = "x" * 50
    assert split(text) == ["x" * 20, "x" * 20, "x" * 20]
    # The blank stays with the long word, which is then cut in windows of 20 with steps of 15.
    assert split("ab " + text) == ["ab", "x" * 19, "x" * 20, "x" * 20, "x" * 6]


@pytest.mark.parametrize("seed", range(20))
def test_chunks_are_short_ordered_and_complete(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(3, 60)))
    text = "".join(rng.choice([word(), word(), " ", "\n", "\n\n"]) for _ in range(300))
    chunks = split(text, 40, 10)
    assert all(0 < len(c) <= 40 and c == c.strip() for c in chunks)
    # Each chunk lies in the text at or after its predecessor's start, and no visible character is lost.
    covered, at = set(), 0
    for chunk in chunks:
        at = text.index(chunk, at)
        covered |= set(range(at, at + len(chunk)))
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_chunk_tables(spark):
    frame = spark.createDataFrame([(1, "a" * 1700), (2, ""), (3, None), (4, "short")], "id int, content string")
    for make in (chunking.chunk_recursive, chunking.chunk_fixed):
        rows = sorted((r["id"], r["chunk_id"], len(r["text"])) for r in make(frame).collect())
        assert rows == [(1, 0, 800), (1, 1, 800), (1, 2, 300), (4, 0, 5)]
    nested = chunking.nest_chunks(chunking.chunk_recursive(frame), "id", ["text"])
    assert {r["id"]: [c["chunk_id"] for c in r["chunks"]] for r in nested.collect()} == {1: [0, 1, 2], 4: [0]}


def test_hash_embedder():
    model = embedding.hash_embedder(64)()
    vectors = model(["Hello, world", "hello WORLD", "", "--"])
    assert np.allclose(vectors[0], vectors[1]) and np.isclose(np.linalg.norm(vectors[0]), 1)
    assert not vectors[2].any() and not vectors[3].any()


def test_custom_model_is_loaded_in_the_task(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    frame = spark.createDataFrame([("abc",), (None,)], "text string")
    rows = [r["embedding"] for r in embedding.embed_chunks(frame, load).collect()]
    assert sorted(rows) == [[0.0, 1.0], [3.0, 1.0]]


def test_wrong_dimensions_are_rejected(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, embedding array<float>")
    valid, rejected = embedding.validate_embedding_dim(frame, 2)
    assert [r["id"] for r in valid.collect()] == [1]
    assert sorted(r["id"] for r in rejected.collect()) == [2, 3]
    mocked = frame.select(embedding.embedding_or_mock(F.col("embedding"), 3).alias("e")).collect()
    assert [0.0, 0.0, 0.0] in [r["e"] for r in mocked]


def test_long_batches_are_split_in_runs_of_texts(monkeypatch):
    monkeypatch.setattr(chunking, "TEXT_BYTES", 1000)
    batch = pa.array(["x" * 300, None, "", "y" * 5000, "z" * 10] * 40)
    blocks = list(chunking._blocks(batch))
    assert pa.concat_arrays(blocks).equals(batch)
    assert all(len(b) == 1 or sum(len(t or "") for t in b.to_pylist()[1:]) <= 1000 for b in blocks)
    assert len(list(chunking._blocks(pa.array([], pa.string())))) == 0


def test_a_model_gets_bounded_lists_of_texts(spark):
    def load():
        def model(texts):
            return np.full((len(texts), 1), float(len(texts)))
        return model

    frame = spark.range(2500).coalesce(1).select(F.col("id").cast("string").alias("text"))
    sizes = [r[0] for r in embedding.embed_chunks(frame, load).select(F.get("embedding", 0)).collect()]
    assert len(sizes) == 2500 and max(sizes) <= 1000
