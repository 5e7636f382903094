"""Nearest neighbours by inner product with learned binary codes and multi-index hashing.

Codes: vectors get one more component that makes all of them equally long (queries get 0), so that the largest inner
product is the smallest angle. Rotations learned on a bounded sample (iterative quantisation: principal directions,
then rotations that bring the sample closest to its own signs) turn a vector into bits.

Search: the bits are split into substrings, and each has an index from its value to rows. If two codes differ in at
most r bits, one of the m substrings differs in at most r/m, so probing each index for all values that near retrieves
every code within r (pigeonhole). What is within r is reranked by the inner product of the original vectors.

Candidates lie in shards and queries in blocks of bounded size; each (shard, block) pair is one task, which builds the
indexes of its shard in memory and hands on k rows per query. A popular vector costs no more than others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.operators.joins import first_per_key
from articleflow.session import cut

K = 20
BITS = 128
SUBSTRING_BITS = 16
# Rows the rotations are learned on, at most, and queries the radius is set by; both by order of a hash.
FIT_ROWS, PROBE_QUERIES = 4096, 128
# The radius takes in this share of the exact neighbours of the probe queries.
COVERAGE = 0.97
# Bounds of a task: candidates of a shard (on average), queries of a block.
SHARD_ROWS, BLOCK_ROWS = 50_000, 4_096


@dataclass
class Codes:
    """A learned encoder: ``scale`` is the longest candidate's length."""

    scale: float
    basis: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, scale: float, bits: int = BITS, rounds: int = 30, seed: int = 7) -> Codes:
        rng = np.random.default_rng(seed)
        longer = _lengthened(sample, scale)
        block = min(64, longer.shape[1])
        _, axes = np.linalg.eigh(longer.T @ longer)
        axes = axes[:, ::-1][:, :block]
        flat = longer @ axes
        found = []
        for _ in range(-(-bits // block)):
            turn = np.linalg.qr(rng.standard_normal((block, block)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.sign(flat @ turn).T @ flat)
                turn = (u @ vt).T
            found.append(axes @ turn)
        return Codes(scale, np.concatenate(found, axis=1))

    def encode(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        longer = np.pad(vectors, ((0, 0), (0, 1))) if queries else _lengthened(vectors, self.scale)
        signs = longer @ self.basis > 0
        signs = np.pad(signs, ((0, 0), (0, -signs.shape[1] % SUBSTRING_BITS)))
        return np.packbits(signs, axis=1).view(">u2").astype(np.uint16)


def _lengthened(vectors: np.ndarray, scale: float) -> np.ndarray:
    squares = (vectors * vectors).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(scale * scale - squares, 0))[:, None]], axis=1)


def _by_distance() -> tuple[np.ndarray, np.ndarray]:
    """(all differences of a substring, fewest bits first; how many have at most 0, 1, ... bits)."""
    differences = np.arange(1 << SUBSTRING_BITS, dtype=np.uint16)
    bits = np.bitwise_count(differences)
    return differences[np.argsort(bits, kind="stable")], np.cumsum(np.bincount(bits))


class MultiIndex:
    """Look-up tables of all substrings of a shard's codes: the rows of every value lie together."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.differences, self.upto = _by_distance()
        self.tables = []
        for column in codes.T:
            counts = np.bincount(column, minlength=1 << SUBSTRING_BITS)
            present = np.flatnonzero(counts).astype(np.uint16)
            self.tables.append((np.append(0, np.cumsum(counts)), np.argsort(column, kind="stable"), present))

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of all codes that differ from ``code`` in at most ``radius`` bits.

        Of each substring the values within its share of the radius are looked up, or, if those are more than the
        values that occur, the latter are compared.
        """
        share, extra = divmod(radius, len(self.tables))
        hit = np.zeros(len(self.codes), dtype=bool)
        for nth, (offsets, order, present) in enumerate(self.tables):
            # radius = m * share + extra: extra + 1 substrings probed up to share and the others to one less suffice.
            bits = min(share if nth <= extra else share - 1, SUBSTRING_BITS)
            if bits < 0:
                continue
            if self.upto[bits] < len(present):
                values = (self.differences[:self.upto[bits]] ^ code[nth]).astype(np.int64)
            else:
                values = present[np.bitwise_count(present ^ code[nth]) <= bits].astype(np.int64)
            starts = offsets[values]
            n = offsets[values + 1] - starts
            hit[order[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        rows = np.flatnonzero(hit)
        distance = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64)
        near = distance <= radius
        return rows[near], distance[near]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _grid(queries: DataFrame, rows: DataFrame, codes: Codes, width: int, radius: int, k: int, shards: int,
          blocks: int) -> DataFrame:
    """The k nearest of each query among what lies within ``radius``: (query_id, vec_id, score, distance, rank)."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        ids = left["vec_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids = ids[by_id]
        vectors = _matrix(left["embedding"], width)[by_id]
        asked = _matrix(right["embedding"], width)
        index = MultiIndex(codes.encode(vectors)) if len(ids) else None
        wanted = codes.encode(asked, queries=True) if len(asked) else []
        for query_id, query, code in zip(right["query_id"].to_pylist(), asked, wanted):
            if index is None:
                break
            near, distance = index.within(code, radius)
            other = ids[near] != query_id
            near, distance = near[other], distance[other]
            score = (vectors[near] * query).sum(axis=1)
            if len(near) > k:
                top = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                near, distance, score = near[top], distance[top], score[top]
            best = np.lexsort((ids[near], -score))[:k]
            found += [(query_id, *hit) for hit in zip(ids[near[best]].tolist(), score[best].tolist(), distance[best].tolist())]
        columns = list(zip(*found)) or [()] * 4
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)],
                        names=["query_id", "vec_id", "score", "distance"])

    shard = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).alias("shard")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    left = rows.select("vec_id", "embedding", shard, F.explode(_numbers(blocks)).alias("block"))
    right = queries.select("query_id", "embedding", F.explode(_numbers(shards)).alias("shard"), block)
    partial = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        search, "query_id long, vec_id long, score double, distance long")
    return first_per_key(partial, ["query_id"], [F.col("score").desc(), F.col("vec_id").asc()], k, "rank")


def usable(vectors: DataFrame, id_col: str, vector_col: str, width: int | None = None) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part: not null, not zero, all components finite, id not null.

    Vectors of another length than ``width`` take no part.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias(
        "embedding")).filter("vec_id is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = named.filter(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    return named if width is None else named.filter(F.size("embedding") == width)


def nearest(vectors: DataFrame, query_filter: str, id_col: str = "vec_id", vector_col: str = "embedding",
            k: int = K) -> DataFrame:
    """The k nearest vectors by inner product of each query: (query_id, rank, vec_id, score), rank from 1.

    Queries are the usable vectors whose ``vec_id`` fulfils ``query_filter``; every usable row with another id is a
    candidate. Ties go to the smaller id. Vectors that are null, zero, hold null or non-finite components, have no id
    or another length than most take no part. A query that finds fewer than k within the radius is searched again
    among all candidates; it gets fewer rows only if there are fewer candidates. Repeated rows are candidates each;
    an id with several vectors asks with the one that sorts first.
    """
    lengths = usable(vectors, id_col, vector_col).groupBy(F.size("embedding").alias("width")).count()
    most = lengths.orderBy(F.col("count").desc(), F.col("width").desc()).first()
    spark = vectors.sparkSession
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = most["width"], most["count"]
    rows = usable(vectors, id_col, vector_col, width)
    queries = rows.filter(query_filter).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    scale = float(np.sqrt(rows.agg(F.max(square)).first()[0]))
    # Both are bounded samples.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(FIT_ROWS).select("embedding").toArrow()
    codes = Codes.fit(_matrix(sample["embedding"], width), scale)
    bits = codes.basis.shape[1]
    cores = spark.sparkContext.defaultParallelism
    shards = max(2 * cores, -(-total // SHARD_ROWS))
    probes = cut(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(PROBE_QUERIES))
    exact = _grid(probes, rows, codes, width, bits, k, shards, 1)
    radius = exact.agg(F.percentile("distance", COVERAGE)).first()[0]
    radius = bits if radius is None else min(bits, int(np.ceil(radius)))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    found = cut(_grid(queries, rows, codes, width, radius, k, shards, blocks))
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    short = cut(queries.join(full, "query_id", "left_anti"))
    if not short.isEmpty():
        again = _grid(short, rows, codes, width, bits, k, shards, max(1, -(-short.count() // BLOCK_ROWS)))
        found = found.join(full, "query_id", "left_semi").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")
