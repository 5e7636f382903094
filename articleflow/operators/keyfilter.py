"""Key filters beside the partitions of a stored table: which partitions may hold any of a batch's keys.

Beside every stored batch (``run``, ``batch_id``) lies a Bloom filter of its keys, in segments of bounded size, below
``<table>/_keys``. A batch's keys are tested against all filters in one pass over them; only partitions in which a key
may occur are read. A partition without a filter, as one of an older table or of a failed write, counts as one that may.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bits for each key, and positions set by it: a foreign key passes a filter with a probability below one in a million.
KEY_BITS, POSITIONS = 32, 8
# Keys of one segment of a filter, on average.
SEGMENT_KEYS = 1_000_000
# Hashes of a batch's keys are sent to every task up to this many; a larger batch is likely to meet every partition.
PROBE_KEYS = 2_000_000
_FILTERS = "n int, segment int, bits binary, run string, batch_id bigint"


def key_hash(key: str) -> Column:
    """64-bit hash of a key; null is a key of its own."""
    return F.xxhash64(F.col(key).isNull(), F.col(key))


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash (rows), by double hashing."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (low[:, None] + np.arange(1, POSITIONS + 1, dtype=np.uint64) * high[:, None]) % np.uint64(bits)


def _segment_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(17)) % np.uint64(n)


def _filter(hashes: np.ndarray) -> bytes:
    bits = max(64, 1 << int(np.ceil(np.log2(max(1, KEY_BITS * len(hashes))))))
    marks = np.zeros(bits, dtype=bool)
    marks[_positions(hashes, bits).ravel()] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _passes(raw: bytes, hashes: np.ndarray) -> np.ndarray:
    field = np.frombuffer(raw, dtype=np.uint8)
    spot = _positions(hashes, 8 * len(field))
    return ((field[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def filter_path(path: str) -> str:
    return os.path.join(path, "_keys")


def write_filter(rows: DataFrame, path: str, key: str, batch_id: int, run: str) -> None:
    """The filter of the keys of one stored batch, in place of an earlier one."""
    keys = rows.select(key_hash(key).alias("hash"))
    n = max(1, -(-keys.count() // SEGMENT_KEYS))
    dealt = keys.withColumn("segment", F.pmod(F.shiftrightunsigned("hash", 17), F.lit(n)).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        return pa.table({"n": pa.array([n], pa.int32()), "segment": pa.array([group["segment"][0].as_py()], pa.int32()),
                         "bits": pa.array([_filter(group["hash"].to_numpy())], pa.binary())})

    dealt.groupBy("segment").applyInArrow(build, "n int, segment int, bits binary").write.mode("overwrite").parquet(
        os.path.join(filter_path(path), f"run={run}", f"batch_id={batch_id}"))


def drop_filter(spark: SparkSession, path: str, batch_id: int, run: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(filter_path(path), f"run={run}", f"batch_id={batch_id}"))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _batches(spark: SparkSession, path: str) -> set[tuple[str, str]]:
    """(run, batch_id) of the stored partitions, by listing folders."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "run=*/batch_id=*"))
    names = [status.getPath() for status in found or []]
    return {(p.getParent().getName().split("=", 1)[1], p.getName().split("=", 1)[1]) for p in names}


def partitions_to_read(keys: DataFrame, key: str, path: str) -> set[tuple[str, str]] | None:
    """(run, batch_id) of the stored batches that may hold one of ``keys``; None if the batch is too large to tell.

    One entry per stored batch reaches the driver, and a bounded number of hashes leaves it.
    """
    spark = keys.sparkSession
    stored, filtered = _batches(spark, path), _batches(spark, filter_path(path))
    if not stored & filtered:
        return stored
    hashes = keys.select(key_hash(key).alias("hash")).limit(PROBE_KEYS + 1).toArrow()["hash"].to_numpy()
    if len(hashes) > PROBE_KEYS:
        return None
    shared = spark.sparkContext.broadcast(hashes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            hit = []
            for n, segment, bits in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = asked[_segment_of(asked, n) == segment]
                hit.append(bool(len(own)) and bool(_passes(bits, own).any()))
            chosen = pa.array(np.flatnonzero(hit), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(3).take(chosen), batch.column(4).take(chosen)], ["run", "batch_id"])

    filters = spark.read.schema(_FILTERS).parquet(filter_path(path))
    hit = filters.select("n", "segment", "bits", F.col("run").cast("string").alias("run"), "batch_id").mapInArrow(
        probe, "run string, batch_id long").distinct()
    met = {(row["run"], str(row["batch_id"])) for row in hit.collect()}
    return (met & stored) | (stored - filtered)
