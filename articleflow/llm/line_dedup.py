"""Removal of passages that occurred before, by winnowing over line hashes.

A run is a sequence of consecutive non-blank lines with at least ``min_words`` words; lines are compared in lower case
with white space collapsed. A run is repeated if the same lines stand somewhere earlier, wholly before it, in the order
(document id, hash of the text, line). Every line of a repeated run is deleted; the first occurrence stays.

Winnowing: of every shortest run that starts at a line (a window), the line with the smallest hash is selected. Equal
runs hold equal windows, so they are guaranteed to share a selected line. Positions that share a selected line with
another position are joined, and around them the match is extended both ways: a line belongs to a repeated run exactly
if a shortest run reaching it from the left or from the right, which both hold a selected line, has an earlier equal.
So each extension is one comparison with the earliest equal run, and no two positions of a popular passage are paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import BROADCAST_BYTES, fresh, gives_back, text_slices
from articleflow.session import cut

MIN_WORDS = 50


def line_runs(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes, int]]:
    """(first line, last line, run hash, hash of the selected line) of all shortest runs of a text.

    Shortest means: dropping the last line (runs reaching right from their first line) or the first one (runs
    reaching left from their last line) leaves fewer than ``min_words`` words.
    """
    places, counts, hashes = [], [], []
    for place, line in enumerate(text.split("\n")):
        words = line.lower().split()
        if words:
            places.append(place)
            counts.append(len(words))
            hashes.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
    upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)
    n = len(places)
    lines = np.arange(n)
    ends = np.searchsorted(upto, upto[:-1] + min_words, side="left") - 1
    starts = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    runs = {(s, e) for s, e in zip(lines.tolist(), ends.tolist()) if e < n}
    runs |= {(s, e) for s, e in zip(starts.tolist(), lines.tolist()) if s >= 0}
    for s, e in sorted(runs):
        part = hashes[s:e + 1]
        key = part[0] if s == e else hashlib.blake2b(b"".join(part), digest_size=16).digest()
        yield places[s], places[e], key, int.from_bytes(min(part)[:8], "little", signed=True)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, first, last): the repeated shortest runs, whose union is to be deleted."""

    @gives_back
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(2)):
                rows, runs = [], []
                for nth, text in enumerate(texts):
                    for run in line_runs(text, min_words):
                        rows.append(start + nth)
                        runs.append(run)
                take = pa.array(rows, pa.int64())
                first, last, key, fingerprint = zip(*runs) if runs else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(first, pa.int32()),
                     pa.array(last, pa.int32()), pa.array(key, pa.binary()), pa.array(fingerprint, pa.int64())],
                    ["doc_id", "text_hash", "first", "last", "run", "fingerprint"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = cut(
        docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
            windows, f"doc_id {id_type}, text_hash long, first int, last int, run binary, fingerprint long")
    )
    place = F.struct("doc_id", "text_hash", "first", "last")
    shared = runs.groupBy("fingerprint").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    shared = shared.filter("low <> high").select("fingerprint")
    # Written first, the short side leaves a plain join, of which Spark sends a small one everywhere and splits hot keys.
    near = runs.join(cut(shared), "fingerprint").drop("fingerprint")
    earliest = near.groupBy("run").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same_doc = F.col("doc_id").eqNullSafe(F.col("earliest.doc_id")) & (
        F.col("text_hash") == F.col("earliest.text_hash"))
    return near.join(cut(earliest), "run").filter(
        F.when(same_doc, F.col("earliest.last") < F.col("first")).otherwise(True)
    ).select("doc_id", "text_hash", "first", "last")


def _without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the lines of the spans, and how many they were."""
    lines = text.split("\n")
    keep = np.ones(len(lines), dtype=bool)
    for first, last in spans:
        keep[first:last + 1] = False
    return "\n".join([line for line, stays in zip(lines, keep) if stays]), int(len(lines) - keep.sum())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines of repeated runs, plus ``n_removed_lines`` (long).

    All rows and columns stay (a clashing column name gets an underscore: the new column is always the last one);
    texts without a repeated run are returned as they are, null included; a text that loses all its lines becomes
    empty. Rows that agree in id and text are one document and treated alike; null ids come first in the order.

    The deleted spans are sent to every task while they are few (measured in bytes); else the texts are shuffled.
    """
    spans = repeated_runs(docs, id_col, text_col, min_words).groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))
    cut_id, cut_hash, firsts, lasts, text, removed = fresh(
        docs, "_cut_id", "_cut_hash", "_first", "_last", "_kept_text", "n_removed_lines")
    spans = cut(spans.select(F.col("doc_id").alias(cut_id), F.col("text_hash").alias(cut_hash),
                             F.transform("spans", lambda s: s["first"]).alias(firsts),
                             F.transform("spans", lambda s: s["last"]).alias(lasts)))
    size = spans.agg(F.sum(64 + 8 * F.size(firsts))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        spans = F.broadcast(spans)

    @F.pandas_udf("text string, removed long")
    def strip(texts, starts, ends):
        import pandas as pd

        done = [_without(t, list(zip(a, b))) for t, a, b in zip(texts, starts, ends)]
        return pd.DataFrame({"text": pd.Series([d[0] for d in done], dtype=object),
                             "removed": pd.Series([d[1] for d in done], dtype="int64")})

    text_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    same = docs[id_col].eqNullSafe(spans[cut_id]) & (text_hash == spans[cut_hash])
    joined = docs.join(spans, same, "left")
    touched = joined.filter(F.col(firsts).isNotNull()).withColumn(text, strip.asNondeterministic()(text_col, firsts, lasts))
    rest = joined.filter(F.col(firsts).isNull())
    columns = [c for c in docs.columns]
    changed = touched.select(
        *[F.col(f"{text}.text").alias(c) if c == text_col else F.col(c) for c in columns],
        F.col(f"{text}.removed").alias(removed))
    return changed.unionByName(rest.select(*columns, F.lit(0).cast("long").alias(removed)))
