import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from articleflow.operators import dedup
from articleflow.operators.joins import salted_join


def one_by_one(items):
    seen, kept = set(), []
    for order, buckets in sorted(items):
        if not seen & set(buckets):
            seen |= set(buckets)
            kept.append(order)
    return kept


@pytest.mark.parametrize("seed, hot_rows", [(0, 100_000), (1, 100_000), (2, 4), (3, 4)])
def test_first_arrivals_equals_the_sequential_loop(spark, seed, hot_rows):
    rng = random.Random(seed)
    # A third of the items shares one bucket; the others collide at random, in chains.
    items = [
        (i, ["0:hot" if rng.random() < 0.33 else f"0:{rng.randrange(60)}", f"1:{rng.randrange(150)}", f"2:{rng.randrange(150)}"])
        for i in range(200)
    ]
    frame = spark.createDataFrame(items, "id int, buckets array<string>")
    kept = dedup.first_arrivals(frame, "id", hot_rows)
    assert sorted(r["id"] for r in kept.collect()) == one_by_one(items)


def test_long_chain(spark):
    # Each item collides with its neighbour only: every second one stays.
    items = [(i, [f"0:{i // 2}", f"1:{(i + 1) // 2}"]) for i in range(12)]
    frame = spark.createDataFrame(items, "id int, buckets array<string>")
    kept = sorted(r["id"] for r in dedup.first_arrivals(frame, "id").collect())
    assert kept == one_by_one(items) == [0, 2, 4, 6, 8, 10]


def article_frame(spark, texts):
    return spark.createDataFrame([(i, "t", text) for i, text in enumerate(texts)], "id int, title string, content string")


def test_copies_short_texts_and_near_copies(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [base, base.upper(), "", base.replace("word7 ", "other "), "x", "something else entirely here", base]
    frame = article_frame(spark, texts)
    kept = sorted(r["id"] for r in dedup.near_dup_filter(frame, ["id"]).collect())
    assert 0 in kept and 5 in kept
    assert 1 not in kept and 6 not in kept
    # Below three words there are no shingles, and all such articles look alike: the first one stays.
    assert 2 in kept and 4 not in kept
    pairs = {(r["id"], r["kept_id"]): r["jaccard"] for r in dedup.near_dup_pairs_verified(frame, "id", ["id"]).collect()}
    assert pairs[(1, 0)] == pairs[(6, 0)] == pairs[(4, 2)] == 1.0


def test_signature_estimates_jaccard():
    a, b = dedup.permutations()
    one = " ".join(f"w{i}" for i in range(1000))
    two = " ".join(f"w{i}" for i in range(500, 1500))
    same = np.mean(dedup._signature(one, a, b, 3) == dedup._signature(two, a, b, 3))
    assert abs(same - 1 / 3) < 0.15


def test_signature_by_definition():
    import hashlib

    a, b = dedup.permutations(8)
    text = "The quick brown fox jumps over the lazy dog"
    words = text.lower().split()
    hashes = [int.from_bytes(hashlib.sha1(" ".join(words[i:i + 3]).encode()).digest()[:4], "little") for i in range(7)]
    slow = [min((int(x) * h + int(y)) % 2**64 % (2**61 - 1) % 2**32 for h in hashes) for x, y in zip(a, b)]
    assert dedup._signature(text, a, b, 3).tolist() == slow


def test_optimal_bands():
    assert dedup.optimal_bands(0.95, 128) == (3, 42)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_keeps_every_row(spark, how):
    many = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    one = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    joined = salted_join(many, one, ["k"], ["id"], how, hot_rows=20)
    plain = many.join(one, "k", how)
    assert sorted(map(tuple, joined.select("id", "k", "v").collect()), key=repr) == \
        sorted(map(tuple, plain.select("id", "k", "v").collect()), key=repr)


def test_short_articles_can_be_left_alone(spark):
    rows = [(1, "a", "b"), (2, "c", ""), (3, None, None), (4, "one two", "three four"), (5, "one two", "three four")]
    frame = spark.createDataFrame(rows, "n int, title string, content string")
    assert sorted(r["n"] for r in dedup.near_dup_filter(frame, ["n"]).collect()) == [1, 4]
    assert sorted(r["n"] for r in dedup.near_dup_filter(frame, ["n"], min_words=3).collect()) == [1, 2, 3, 4]
