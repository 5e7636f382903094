"""A stored vector index: the chunk table dealt into cells around centroids, probed by cell.

Centroids are fitted on a bounded sample of the vectors; every vector is then stored in the cell of its nearest centroid
(by cosine). A query probes the cells whose centroids are nearest to it and is scored exactly against their vectors.
Each cell keeps the widest angle between its centroid and a vector, so that a cell that cannot hold a better hit is
known without reading it: ``exact=True`` goes on with the other cells until no better hit is possible.

How many cells are probed is measured when the index is written: a bounded sample of the vectors is searched exactly, and
as many of the nearest cells are probed as hold the wanted share of its hits.

Layout below ``path``: ``vectors`` (Parquet, partitioned by cell; key, embedding, shard), ``cells`` (cell, centroid, n,
widest) and ``figures`` (probes). A cell with very many vectors, as of copies of one, is searched in shards of bounded
size.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow import constants as C
from articleflow.operators import retrieval
from articleflow.operators.joins import small_side
from articleflow.operators.keyword import DECIMALS, merge_topk
from articleflow.session import cut

# Vectors that fit the centroids: those with the smallest hash of their key. All vectors are indexed.
SAMPLE = 20_000
# Cells are about the square root of the vectors, within these bounds.
MIN_CELLS, MAX_CELLS = 4, 4_096
# Vectors of one shard of a cell, and queries searched together.
SHARD_VECTORS, QUERY_BLOCK = 20_000, 10_000
# Share of the nearest vectors that probing is to find, and the sample of vectors that sets the number of probes.
RECALL, PROBE_QUERIES = 0.95, 256
# Angles are computed in doubles; bounds within this distance may still tie.
_SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """A written index: its tables, and the bounded table of its cells by cell number."""

    vectors: DataFrame
    cells: DataFrame
    dim: int
    probes: int


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows scaled to length 1; zero vectors stay zero."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _comparable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has the right length and only finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return vectors.filter((F.size("embedding") == dim) & finite)


def _fit(vectors: DataFrame, cells: int, sample: int, seed: int) -> np.ndarray:
    """Centroids of a bounded sample: the vectors whose keys have the smallest hashes."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    chosen = vectors.filter(length > 0).orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(sample)
    points = cut(chosen.select("embedding")).select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if points.isEmpty():
        return np.zeros((0, 0))
    model = KMeans(k=cells, seed=seed, maxIter=15, distanceMeasure="cosine").fit(points)
    return np.array(model.clusterCenters())


def write_vector_index(vectors: DataFrame, path: str, key: str = "chunk_key", cells: int | None = None,
                       sample: int = SAMPLE, shard_vectors: int = SHARD_VECTORS, recall: float = RECALL,
                       seed: int = 7) -> VectorIndex:
    """Index the vectors of a chunk table (``key``, ``embedding``) below ``path``.

    Queries will probe as many cells as hold the share ``recall`` of the ten nearest vectors of ``PROBE_QUERIES``
    sampled ones, in one scan of the vectors.

    Vectors that are null, of another length than most, or hold null or non-finite components are left out.
    Zero vectors are kept; their cosine with anything is 0.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(key).alias("key"), "embedding").filter("embedding is not null")
    # Few lengths occur; the most frequent one counts.
    lengths = named.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = lengths or (0, 0)
    named = _comparable(named, dim)
    cells = cells or int(min(MAX_CELLS, max(MIN_CELLS, math.sqrt(n))))
    centers = _fit(named, min(cells, max(1, n)), sample, seed) if n else np.zeros((0, 0))
    if not len(centers):
        centers = np.zeros((1, max(1, dim)))
    shared = spark.sparkContext.broadcast(centers)
    key_field = T.StructField("key", vectors.schema[key].dataType)
    schema = T.StructType([key_field, vectors.schema["embedding"], *T.StructType.fromDDL("cell int, cosine double").fields])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = shared.value
        around = around / np.maximum(np.linalg.norm(around, axis=1, keepdims=True), 1e-300)
        for batch in batches:
            likeness = _unit(batch.column(1), dim) @ around.T
            cell = likeness.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)),
                 pa.array(likeness[np.arange(len(cell)), cell])], schema.fieldNames())

    assigned = cut(named.mapInArrow(assign, schema))
    sizes = cut(assigned.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least")))
    shards = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / shard_vectors).cast("int").alias("shards")))
    shard = F.pmod(F.xxhash64("key"), F.col("shards")).cast("int").alias("shard")
    (
        assigned.join(shards, "cell").select("key", "embedding", shard, "cell").hint("rebalance", "cell")
        .write.partitionBy("cell").parquet(os.path.join(path, "vectors"))
    )
    around = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, centroid array<double>")
    widest = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "least"))).alias("widest")
    sizes.join(F.broadcast(around), "cell").select("cell", "centroid", "n", widest).coalesce(1).write.parquet(
        os.path.join(path, "cells"))
    probes = _needed_probes(_opened(spark, path, 0), recall, seed)
    spark.createDataFrame([(probes,)], "probes int").coalesce(1).write.parquet(os.path.join(path, "figures"))
    return open_vector_index(spark, path)


def _needed_probes(index: VectorIndex, wanted: float, seed: int, k: int = C.SEARCH_LIMIT) -> int:
    """The least number of nearest cells that hold the wanted share of the sampled vectors' hits, their own left out."""
    if not index.dim:
        return 1
    stored = index.vectors.select("key", "embedding")
    sampled = cut(stored.orderBy(F.xxhash64("key", F.lit(seed + 1)), "key").limit(PROBE_QUERIES).select(
        F.col("key").alias("query_id"), "embedding"))
    exact = retrieval.vector_topk(sampled, stored, k + 1, "key").filter(F.col("id") != F.col("query_id"))
    placed = index.vectors.select(F.col("key").alias("id"), "cell").join(small_side(cut(exact)), "id")
    near = _near_cells(sampled, index).select("query_id", F.posexplode("cells").alias("nearness", "c")).select(
        "query_id", "nearness", "c.cell")
    # One row per number of cells.
    counts = placed.join(near, ["query_id", "cell"]).groupBy("nearness").count().orderBy("nearness").collect()
    total, so_far = sum(row["count"] for row in counts), 0
    for row in counts:
        so_far += row["count"]
        if so_far >= wanted * total:
            return row["nearness"] + 1
    return 1


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index written before."""
    return _opened(spark, path, spark.read.parquet(os.path.join(path, "figures")).first()["probes"])


def _opened(spark: SparkSession, path: str, probes: int) -> VectorIndex:
    cells = spark.read.parquet(os.path.join(path, "cells"))
    first = cells.select(F.size("centroid")).first()
    if first is None:
        # No vector was stored: the folder has no partition to take the columns from.
        return VectorIndex(spark.createDataFrame([], "key string, embedding array<float>, shard int, cell int"), cells, 0, probes)
    return VectorIndex(spark.read.parquet(os.path.join(path, "vectors")), cells, first[0], probes)


def _near_cells(queries: DataFrame, index: VectorIndex) -> DataFrame:
    """(query_id, embedding, cell, nearness, best): every cell with its place by nearness and its best possible cosine.

    The cells are a bounded table and travel to the tasks of the queries.
    """
    listed = index.cells.select("cell", "centroid", "widest").orderBy("cell").toArrow()
    centers, widest = _unit(listed["centroid"].combine_chunks(), index.dim), listed["widest"].to_numpy()
    shared = queries.sparkSession.sparkContext.broadcast((listed["cell"].to_numpy(), centers, widest))
    schema = T.StructType([queries.schema["query_id"], queries.schema["embedding"], *T.StructType.fromDDL(
        "cells array<struct<cell: int, best: double>>").fields])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, around, width = shared.value
        for batch in batches:
            unit = _unit(batch.column(1), around.shape[1])
            angle = np.arccos(np.clip(unit @ around.T, -1, 1))
            # Zero queries score 0 everywhere.
            best = np.where(np.linalg.norm(unit, axis=1)[:, None] > 0, np.cos(np.maximum(angle - width, 0)), 0.0)
            # A zero vector scores 0 wherever it lies.
            best = np.maximum(best, 0.0) + _SLACK
            order = np.argsort(angle, axis=1, kind="stable")
            flat = pa.StructArray.from_arrays(
                [pa.array(numbers[order].ravel().astype(np.int32)), pa.array(np.take_along_axis(best, order, 1).ravel())],
                ["cell", "best"])
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(numbers))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, flat)],
                                             schema.fieldNames())

    return queries.mapInArrow(rank, schema)


def _probe(probes: DataFrame, index: VectorIndex, k: int, query_block: int) -> DataFrame:
    """Exact scores of the probed cells' vectors: (query_id, id, score), k per query, cell shard and block of queries."""
    cells = [row[0] for row in probes.select("cell").distinct().collect()]
    blocks = max(1, -(-probes.select("query_id").distinct().count() // query_block))
    vectors = index.vectors.filter(F.col("cell").isin(cells))
    shards = F.broadcast(cut(vectors.groupBy("cell").agg((F.max("shard") + 1).alias("shards"))))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    asked = probes.join(shards, "cell").select(
        "query_id", "embedding", "cell", number, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    stored = vectors.select("key", F.col("embedding").alias("vector"), "cell", "shard", F.explode(
        F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    schema = T.StructType([probes.schema["query_id"], T.StructField("id", index.vectors.schema["key"].dataType),
                           T.StructField("score", T.DoubleType())])
    dim = index.dim

    def score(found: pa.Table, wanted: pa.Table) -> pa.Table:
        found = found.sort_by("key")
        likeness = _unit(wanted["embedding"].combine_chunks(), dim) @ _unit(found["vector"].combine_chunks(), dim).T
        likeness = np.round(likeness, DECIMALS) + 0.0
        # Of equal scores the smaller keys, which come first.
        best = np.argsort(-likeness, axis=1, kind="stable")[:, :k]
        queries = pa.array(np.repeat(np.arange(len(best)), best.shape[1]))
        return pa.table({
            "query_id": wanted["query_id"].combine_chunks().take(queries),
            "id": found["key"].combine_chunks().take(pa.array(best.ravel())),
            "score": np.take_along_axis(likeness, best, 1).ravel(),
        })

    keys = ("cell", "shard", "block")
    return stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        lambda found, wanted: score(found, wanted) if found.num_rows and wanted.num_rows else _nothing(schema), schema)


def _nothing(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def probed_topk(queries: DataFrame, index: VectorIndex, k: int = C.SEARCH_LIMIT, probes: int | None = None,
                exact: bool = False, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest vectors by cosine: (query_id, id, score, rank), as ``vector_topk`` gives them.

    A query probes ``probes`` cells (those of the index if not given), nearest first. Queries that found fewer than ``k``
    go on with all other cells; with ``exact=True`` every query goes on with those other cells that can still hold a better or equal
    hit. Queries without a comparable vector find nothing.
    """
    spark = queries.sparkSession
    result = T.StructType([queries.schema["query_id"], T.StructField("id", index.vectors.schema["key"].dataType),
                           T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    if not index.dim:
        return spark.createDataFrame([], result)
    asked = _comparable(queries.select("query_id", "embedding"), index.dim)
    ranked = cut(_near_cells(asked, index))
    n_cells = index.cells.count()
    probes = min(n_cells, max(1, probes or index.probes))
    listed = ranked.select("query_id", "embedding", F.posexplode("cells").alias("nearness", "c")).select(
        "query_id", "embedding", "nearness", "c.cell", "c.best")
    first = cut(_probe(listed.filter(F.col("nearness") < probes), index, k, query_block))
    lists = probes * max(1, -(-(index.cells.agg(F.max("n")).first()[0]) // SHARD_VECTORS))
    found = cut(merge_topk(first, k, lists))
    if probes == n_cells:
        return found
    # The k-th score so far; a query with fewer hits has none.
    reached = found.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("score").alias("bar"))
    rest = listed.filter(F.col("nearness") >= probes).join(small_side(cut(reached)), "query_id", "left")
    short = F.coalesce(F.col("hits"), F.lit(0)) < k
    open_ = short | (F.col("best") >= F.col("bar")) if exact else short
    rest = cut(rest.filter(open_).select("query_id", "embedding", "cell"))
    if rest.isEmpty():
        return found
    more = _probe(rest, index, k, query_block)
    return merge_topk(found.drop("rank").unionByName(more), k, n_cells)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, wanted, met): how many of the exact hits were found."""
    met = found.select("query_id", "id", F.lit(1).alias("met"))
    both = exact.select("query_id", "id").join(met, ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("met").alias("met"))
