"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import pickle
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sides of at most this many bytes are sent to every task; their size is measured first.
BROADCAST_BYTES = 32 << 20
# Text handled by one step inside a task.
SLICE_BYTES = 1 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not use (names are compared without case, as Spark does)."""
    used = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        found.append(name)
    return found


def bounded_side(df: DataFrame, row_bytes: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if rows x ``row_bytes`` stay below the bound, else unchanged (shuffle join).

    ``df`` should be a written, narrow table: it is counted.
    """
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive slices of about ``limit`` characters; a null text is an empty one.

    A slice holds at least one text, however long.
    """
    start, size, part = 0, 0, []
    for row, value in enumerate(texts):
        text = value.as_py() or ""
        if part and size + len(text) > limit:
            yield start, part
            start, size, part = row, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield start, part


def sent_to_tasks(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives ``value`` to a task.

    The value is broadcast as bytes that carry its classes, as functions of this package do, so that workers need no
    copy of the package to read it. A worker process reads it once, and keeps only the value it was asked for last.
    """
    shared, name = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    def given() -> Any:
        slot = kept_in_worker("sent", dict)
        if name not in slot:
            slot.clear()
            slot[name] = pickle.loads(shared.value)
        return slot[name]

    return given


def gives_back(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: tuple[str, ...] = ("sent",)):
    """The task function, which gives memory back to the system: workers outlive their tasks, and serve other operators.

    It begins by dropping what the worker keeps of other operators, all but names that begin with one of ``keeps``, and
    hands back what is free before its first batch and at its end.
    """

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = vars(_worker_home())
        for name in [n for n in home if not n.startswith(("__", *keeps))]:
            del home[name]
        # Tasks without this function may have left free memory, too.
        _hand_back()
        yield from task(batches)
        _hand_back()

    return run


def _hand_back() -> None:
    pa.default_memory_pool().release_unused()
    # Of the C libraries only GNU's keeps it, and has this function.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _worker_home() -> types.ModuleType:
    return sys.modules.setdefault("articleflow_worker", types.ModuleType("articleflow_worker"))


def kept_in_worker(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gave when this worker process first asked for ``name``: costly tools outlive a task."""
    home = _worker_home()
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
