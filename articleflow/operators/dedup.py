"""Near-duplicate filtering with MinHash and LSH bands.

Every step is linear in the number of articles: members of a band bucket are never paired with each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow import constants as C
from articleflow.functions import text as X
from articleflow.operators.joins import HOT_ROWS, salted_join, small_side
from articleflow.session import cut, once

_PRIME = (1 << 61) - 1
_MAX_HASH = (1 << 32) - 1
# Shingles per numpy step: 128 x 256 values stay in the processor cache.
_BLOCK = 256


def article_text() -> Column:
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))


def shingles(articles: DataFrame, size: int = C.SHINGLE_WORDS) -> DataFrame:
    """Adds ``shingles``: the set of lower-cased word windows; empty below ``size`` words."""
    listed = articles.withColumn("_words", X.words(F.lower(article_text())))
    count = F.size("_words") - (size - 1)
    windows = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.concat_ws(" ", *[F.get("_words", i + k) for k in range(size)]),
    )
    empty = F.array().cast("array<string>")
    return listed.withColumn("shingles", F.when(count > 0, F.array_distinct(windows)).otherwise(empty)).drop("_words")


def permutations(num_perm: int = C.NUM_PERM, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash family: a rule, not a table (seeded 64-bit draws below 2^61 - 1)."""
    draw = np.random.RandomState(seed)
    pairs = [
        (draw.randint(1, _PRIME, dtype=np.uint64), draw.randint(0, _PRIME, dtype=np.uint64)) for _ in range(num_perm)
    ]
    table = np.array(pairs, dtype=np.uint64)
    return table[:, 0], table[:, 1]


def _signature(text: str, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Minimum over all word windows of ((a * h + b) mod 2^64 mod p) mod 2^32, h = first 4 bytes of SHA-1."""
    words = text.lower().split()
    lows = np.full(len(a), _MAX_HASH, dtype=np.uint64)
    windows = {" ".join(words[i:i + size]) for i in range(len(words) - size + 1)}
    if not windows:
        return lows
    raw = b"".join(hashlib.sha1(w.encode("utf-8", "surrogatepass")).digest()[:4] for w in windows)
    hashes = np.frombuffer(raw, dtype="<u4").astype(np.uint64)
    prime, mask = np.uint64(_PRIME), np.uint64(_MAX_HASH)
    for start in range(0, len(hashes), _BLOCK):
        x = np.multiply.outer(a, hashes[start:start + _BLOCK])
        x += b[:, None]
        # x mod p by folding the high bits; taking p off once more equals adding 1 in the low 32 bits.
        high = x >> np.uint64(61)
        x &= prime
        x += high
        x += x >= prime
        x &= mask
        np.minimum(lows, x.min(axis=1), out=lows)
    return lows


def minhash_signature(articles: DataFrame, num_perm: int = C.NUM_PERM, size: int = C.SHINGLE_WORDS) -> DataFrame:
    """Adds ``signature`` (array of ``num_perm`` minima); one Arrow pass over the text, no shuffle."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a, b = permutations(num_perm)
        for batch in batches:
            rows = np.empty((len(batch), num_perm), dtype=np.int64)
            for i, text in enumerate(batch):
                rows[i] = _signature(text.as_py(), a, b, size)
            starts = np.arange(len(rows) + 1, dtype=np.int32) * num_perm
            yield pa.ListArray.from_arrays(pa.array(starts), pa.array(rows.ravel()))

    return articles.withColumn("signature", once(sign)(article_text()))


def lsh_bands(signed: DataFrame, bands: int = C.LSH_BANDS, rows: int = C.LSH_ROWS) -> DataFrame:
    """Adds ``buckets``: one key per band, equal exactly when all ``rows`` minima of that band are equal."""
    keys = [
        F.concat(F.lit(f"{i}:"), F.md5(F.concat_ws(",", F.slice("signature", 1 + i * rows, rows).cast("array<string>"))))
        for i in range(bands)
    ]
    return signed.withColumn("buckets", F.array(*keys))


def optimal_bands(threshold: float = C.LSH_THRESHOLD, num_perm: int = C.NUM_PERM) -> tuple[int, int]:
    """The (bands, rows) split with the least equally weighted false-positive plus false-negative area."""
    grid = (np.arange(2000) + 0.5) / 2000
    below, above = grid * threshold, threshold + grid * (1 - threshold)

    def area(bands: int, rows: int) -> float:
        false_pos = (1 - (1 - below ** rows) ** bands).mean() * threshold
        false_neg = ((1 - above ** rows) ** bands).mean() * (1 - threshold)
        return false_pos + false_neg

    splits = [(b, r) for b in range(1, num_perm + 1) for r in range(1, num_perm // b + 1)]
    return min(splits, key=lambda split: area(*split))


def banded(articles: DataFrame, keep: list[Column | str]) -> DataFrame:
    """``keep`` columns plus ``buckets``; the text does not travel further."""
    columns = [F.col(c) if isinstance(c, str) else c for c in keep]
    narrow = articles.select(*columns, F.col("title"), F.col("content"))
    return lsh_bands(minhash_signature(narrow)).drop("title", "content", "signature")


def first_arrivals(items: DataFrame, order: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The ``order`` values kept by "drop an item that shares a bucket with an earlier kept one".

    ``items`` has a unique sortable ``order`` and an array ``buckets``. Per round, an item that comes first among
    the undecided of all its buckets is kept, and the rest of those buckets is dropped: that reproduces the
    one-by-one rule exactly, since a bucket holds at most one kept item. Each round aggregates buckets to their
    minimum, so the work is linear however large a bucket is.
    """
    # Items with equal bucket lists share one fate: all but the first collide with it or with what dropped it.
    heads = items.groupBy("buckets").agg(F.min(order).alias(order))
    slots = heads.select(order, F.explode("buckets").alias("bucket"))
    shared = slots.groupBy("bucket").count().filter("count > 1").select(
        "bucket", (F.col("count") > hot_rows).alias("hot")
    )
    # Few buckets are shared, and few of those are hot (at most slots / hot_rows): hot ones are joined by broadcast.
    tagged = salted_join(slots, shared, ["bucket"], [order], "left", hot_rows)
    undecided = cut(
        tagged.groupBy(order).agg(
            F.collect_list(F.when(F.col("hot").isNotNull(), F.struct("bucket", "hot"))).alias("slots")
        )
    )
    kept = [undecided.filter(F.size("slots") == 0).select(order)]
    undecided = undecided.filter(F.size("slots") > 0)
    while not undecided.isEmpty():
        claims = undecided.select(order, F.explode("slots").alias("slot")).select(order, "slot.bucket", "slot.hot")
        first = claims.groupBy("bucket", "hot").agg(F.min(order).alias("first"))
        per_item = _look_up(claims, first).groupBy(order).agg(
            F.bool_and(F.col(order) == F.col("first")).alias("wins")
        )
        winners = per_item.filter("wins").select(F.col(order).alias("first"))
        closed = first.join(winners, "first", "left_semi")
        state = _look_up(claims, closed, "left").groupBy(order).agg(
            F.bool_or(F.col("first").isNotNull() & (F.col(order) == F.col("first"))).alias("keep"),
            F.bool_or(F.col("first").isNotNull()).alias("decided"),
            F.collect_list(F.struct("bucket", "hot")).alias("slots"),
        )
        state = cut(state)
        kept.append(state.filter("keep").select(order))
        undecided = state.filter("not decided").select(order, "slots")
    return reduce(DataFrame.unionByName, kept)


def _look_up(claims: DataFrame, per_bucket: DataFrame, how: str = "inner") -> DataFrame:
    """Join on bucket; rows of hot buckets stay where they are and meet a broadcast of the few hot entries."""
    cold = claims.filter("not hot").join(per_bucket.filter("not hot").drop("hot"), "bucket", how)
    hot = claims.filter("hot").join(F.broadcast(per_bucket.filter("hot").drop("hot")), "bucket", how)
    return cold.unionByName(hot)


def arrival_order(order: list[str]) -> Column:
    """One sortable column for the arrival order."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def near_dup_filter(articles: DataFrame, order: list[str], min_words: int = 0) -> DataFrame:
    """Articles that survive the near-duplicate filter, first arrival wins; collisions are not verified.

    Articles with fewer than ``min_words`` words are no one's duplicates and stay (those without shingles look alike
    otherwise, and only the first one is kept). ``order`` must identify an article. The dropped ones, few as a rule, are
    anti-joined: while their list is small it is broadcast and the article texts are not shuffled at all.
    """
    compared = articles.filter(F.size(X.words(article_text())) >= min_words) if min_words else articles
    ids = cut(banded(compared, [arrival_order(order).alias("_order")]))
    dropped = cut(ids.select("_order").join(first_arrivals(ids, "_order"), "_order", "left_anti"))
    ordered = articles.withColumn("_order", arrival_order(order))
    return ordered.join(small_side(dropped), "_order", "left_anti").drop("_order")


def _shingle_set(df: DataFrame, name: str) -> DataFrame:
    return shingles(df).withColumn(name, F.transform("shingles", lambda s: F.xxhash64(s))).drop(
        "shingles", "title", "content"
    )


def near_dup_pairs_verified(articles: DataFrame, id_col: str, order: list[str],
                            threshold: float = C.LSH_THRESHOLD) -> DataFrame:
    """Dropped articles with the kept article they repeat: (id, kept id, jaccard) with jaccard > threshold.

    A bucket holds one kept article at most, so a dropped one has no more candidates than bands. The exact
    Jaccard similarity is computed on the full shingle sets.
    """
    ids = cut(banded(articles, [arrival_order(order).alias("_order"), id_col]))
    kept = first_arrivals(ids.select("_order", "buckets"), "_order")
    slots = ids.select("_order", id_col, F.explode("buckets").alias("bucket"))
    kept_slots = slots.join(kept, "_order", "left_semi").select("bucket", F.col(id_col).alias("kept_id"))
    dropped = slots.join(kept, "_order", "left_anti")
    pairs = salted_join(dropped, kept_slots, ["bucket"], [id_col]).select(id_col, "kept_id").distinct()
    # Only articles that occur in a pair are shingled; a hot kept article is repeated per salt, not per pair.
    pairs = cut(pairs)
    text = articles.select(id_col, "title", "content")
    left = _shingle_set(text.join(small_side(pairs), id_col), "_set")
    kept_ids = pairs.select("kept_id").distinct()
    reps = text.withColumnRenamed(id_col, "kept_id").join(small_side(kept_ids), "kept_id", "left_semi")
    both = salted_join(left, _shingle_set(reps, "_kept_set"), ["kept_id"], [id_col])
    shared = F.size(F.array_intersect("_set", "_kept_set"))
    total = F.size("_set") + F.size("_kept_set") - shared
    jaccard = F.when(total == 0, 1.0).otherwise(shared / total)
    return both.select(id_col, "kept_id", jaccard.alias("jaccard")).filter(F.col("jaccard") > threshold)
