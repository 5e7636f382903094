"""Session set-up, shared scratch space and input spreading."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "articleflow", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a fresh temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if base:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(base)
        return base
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        current = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(current)
    return current


_space: ContextVar[str | None] = ContextVar("scratch_space", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder (or below the active ``scratch_space``)."""
    return os.path.join(_space.get() or shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end: a stream's micro-batches leave nothing behind."""
    path = os.path.join(shared_dir(spark), f"space-{uuid.uuid4().hex}")
    token = _space.set(path)
    try:
        yield
    finally:
        _space.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and forget its lineage.

    A written table survives lost executors, and its size and columns are known to the planner afterwards.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes of an Arrow batch of texts between an executor and its Python workers.
TEXT_BATCH_BYTES = 2 << 20


@contextmanager
def text_batches(spark: SparkSession, limit: int = TEXT_BATCH_BYTES) -> Iterator[None]:
    """Tables written inside are sent to Python workers in Arrow batches of about ``limit`` bytes, one row at least.

    Spark's own bound is 64 MB, which the executor and each of its workers hold at once. The session gets its setting
    back at the end, so that what is only planned inside does not count.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def once(udf):
    """Keep the planner from evaluating an expensive Python function a second time in a pushed-down filter."""
    return udf.asNondeterministic()


def spread(scan: DataFrame) -> DataFrame:
    """Give CPU-heavy row work enough tasks when a scanned table has fewer splits than the cluster has cores.

    Meant for plain scans (counting the splits of a plan with shuffles would run it). Large tables have more splits
    than cores and pass through without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
