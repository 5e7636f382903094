"""Articles to chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow import constants as C
from articleflow.session import once

# Text that is cut into chunks at a time within an Arrow batch.
TEXT_BYTES = 1 << 20


def split_spans(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Recursive character split of one text.

    Pieces are kept as (start, end) spans: a separator stays at the head of the piece behind it, so neighbouring
    pieces touch and a chunk is always one slice of the text.
    """
    out: list[str] = []

    def emit(start: int, end: int) -> None:
        chunk = text[start:end].strip()
        if chunk:
            out.append(chunk)

    def pack(pieces: list[tuple[int, int]]) -> None:
        window: deque[tuple[int, int]] = deque()
        for start, end in pieces:
            if window and end - window[0][0] > size:
                emit(window[0][0], start)
                while window and (start - window[0][0] > overlap or end - window[0][0] > size):
                    window.popleft()
            window.append((start, end))
        if window:
            emit(window[0][0], window[-1][1])

    def walk(lo: int, hi: int, level: int) -> None:
        while separators[level] and text.find(separators[level], lo, hi) < 0:
            level += 1
        mark = separators[level]
        if not mark:
            while hi - lo > size:
                emit(lo, lo + size)
                lo += size - overlap
            emit(lo, hi)
            return
        run: list[tuple[int, int]] = []
        start = lo
        while start < hi:
            skip = len(mark) if text.startswith(mark, start) else 0
            end = text.find(mark, start + skip, hi)
            end = hi if end < 0 else end
            if end - start < size:
                run.append((start, end))
            else:
                pack(run)
                run = []
                walk(start, end, level + 1)
            start = end
        pack(run)

    walk(0, len(text), 0)
    return out


def _blocks(batch: pa.Array) -> Iterator[pa.Array]:
    """Runs of a batch's texts, about ``TEXT_BYTES`` long or one text each: only their chunks are Python objects at once."""
    sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // TEXT_BYTES
    starts = np.flatnonzero(np.diff(run, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], len(batch)]):
        yield batch.slice(start, end - start)


def chunk_recursive(articles: DataFrame, text: str = "content", size: int = C.CHUNK_SIZE,
                    overlap: int = C.CHUNK_OVERLAP, separators: tuple[str, ...] = C.CHUNK_SEPARATORS) -> DataFrame:
    """One row per chunk, ``chunk_id`` from 0; articles without chunks drop out. No shuffle."""
    marks = tuple(separators) if "" in separators else (*separators, "")

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lists = [pa.array([], pa.list_(pa.string()))]
            for texts in _blocks(batch):
                lists.append(pa.array(
                    [split_spans(t, size, overlap, marks) if t else [] for t in texts.to_pylist()], pa.list_(pa.string())))
            yield pa.concat_arrays(lists)

    pieces = articles.withColumn("_chunks", once(split)(F.col(text))).drop(text)
    return explode_chunks(pieces, "_chunks")


def chunk_fixed(articles: DataFrame, text: str = "content", size: int = C.CHUNK_SIZE,
                overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """Sliding character windows, built-in functions only."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(step))
    windows = F.transform(starts, lambda o: F.substring(F.col(text), o + 1, F.lit(size)))
    # Exploded where it is computed: over a column, the planner would add a size filter that computes it again.
    chunks = F.posexplode(F.filter(windows, lambda w: F.trim(w) != "")).alias("chunk_id", "text")
    return articles.select(*[c for c in articles.columns if c != text], chunks)


def drop_unchunkable(articles: DataFrame, chunks: str = "chunks") -> DataFrame:
    return articles.filter(F.size(chunks) > 0)


def explode_chunks(articles: DataFrame, chunks: str = "chunks") -> DataFrame:
    """(article, array of chunks) to one row per chunk; articles without chunks drop out."""
    others = [c for c in articles.columns if c != chunks]
    return articles.select(*others, F.posexplode(chunks).alias("chunk_id", "text"))


def nest_chunks(chunks: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per article with its chunks in order; a group is one article's own chunks."""
    items = F.array_sort(F.collect_list(F.struct("chunk_id", *fields)))
    return chunks.groupBy(key).agg(items.alias("chunks"))


def chunk_stats(chunks: DataFrame, key: str = "article_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"))
