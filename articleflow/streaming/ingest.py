"""From article messages to the article and chunk tables, as one streaming query."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from articleflow.functions import text as X
from articleflow.operators.chunking import chunk_recursive
from articleflow.operators.embedding import Embedder, embed_chunks
from articleflow.operators.joins import first_per_key, small_side
from articleflow.operators.normalize import article_rows, dead_letters, good_records, judged_messages
from articleflow.operators.tables import append_absent, replace_batch, upsert_into
from articleflow.session import cut, scratch_space
from articleflow.streaming.dedup import near_dup_batch

INGEST_PERIOD = "30 minutes"


@dataclass(frozen=True)
class Stores:
    """Table locations below one root."""

    root: str
    articles: str = field(init=False)
    chunks: str = field(init=False)
    fingerprints: str = field(init=False)
    dead_letters: str = field(init=False)
    checkpoints: str = field(init=False)

    def __post_init__(self) -> None:
        for name in ("articles", "chunks", "fingerprints", "dead_letters", "checkpoints"):
            object.__setattr__(self, name, os.path.join(self.root, name))


def chunk_rows(articles: DataFrame, load: Callable[[], Embedder] | None = None) -> DataFrame:
    """Embedded chunk rows of articles, with stable keys."""
    pieces = chunk_recursive(articles.select("article_id", "url", "title", "content"))
    keyed = pieces.withColumn("chunk_key", X.chunk_key(F.col("url"), F.col("chunk_id")))
    return embed_chunks(keyed, load).select("chunk_key", "chunk_id", "text", "embedding", "article_id", "title", "url")


def newest_versions(articles: DataFrame) -> DataFrame:
    """One article per url: the one scraped last, then by article id and content. Only repeated urls are sorted."""
    repeated = cut(articles.groupBy("url").count().filter("count > 1").select("url"))
    if repeated.isEmpty():
        return articles
    asked = small_side(repeated)
    several = articles.join(asked, "url", "left_semi")
    newest = first_per_key(several, ["url"], [
        F.col("scraped_at").desc_nulls_last(), F.col("article_id").asc(), F.xxhash64("content").asc()])
    return articles.join(asked, "url", "left_anti").unionByName(newest)


def dual_index(articles: DataFrame, chunks: DataFrame, stores: Stores, batch_id: int, as_of: Column,
               run: str = "run") -> None:
    """One batch into both tables: articles if absent by url, chunks of an article in place of its earlier ones.

    ``articles`` and ``chunks`` hold one version per url. Replays change nothing. Chunks lie in the partition of the
    day they were first indexed.
    """
    append_absent(article_rows(articles, as_of), stores.articles, "url", ["created_at", "id"], batch_id, run)
    dated = chunks.withColumn("day", F.to_date(as_of))
    upsert_into(dated, stores.chunks, "chunk_key", [F.col("text").asc()], group="url")


def ingest_batch(batch: DataFrame, batch_id: int, stores: Stores, order: list[str], as_of: Column,
                 load: Callable[[], Embedder] | None = None, run: str = "run") -> None:
    """De-duplicate, chunk, embed and index one micro-batch."""
    unique = cut(near_dup_batch(newest_versions(batch), stores.fingerprints, batch_id, order, as_of, run=run))
    dual_index(unique, chunk_rows(unique, load), stores, batch_id, as_of, run)


def start_ingest(messages: DataFrame, stores: Stores, order: list[str] | None = None, once: bool = False,
                 as_of: Column | None = None, load: Callable[[], Embedder] | None = None) -> StreamingQuery:
    """The streaming query over article messages: every 30 minutes, or once over what has landed.

    ``messages`` are decoded articles, or raw texts (one column ``value``). Of raw texts the malformed ones are written
    to the dead-letter table (value, reason, run, batch_id) by the batch that indexes the good ones; a replayed batch
    overwrites its own dead letters.
    """
    now = F.current_timestamp() if as_of is None else as_of
    sequence = order or ["scraped_at", "article_id"]
    raw = messages.columns == ["value"]

    def step(batch: DataFrame, batch_id: int) -> None:
        with scratch_space(batch.sparkSession):
            spark = batch.sparkSession
            # One time for all of the batch's jobs; the query's id lasts as long as its checkpoint.
            fixed = F.lit(spark.range(1).select(now.alias("now")).first()["now"])
            run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "run"
            batch = cut(batch)
            if raw:
                judged = cut(judged_messages(batch))
                replace_batch(dead_letters(judged), stores.dead_letters, batch_id, run)
                batch = good_records(judged)
            ingest_batch(batch, batch_id, stores, sequence, fixed, load, run)

    writer = messages.writeStream.foreachBatch(step).option("checkpointLocation", stores.checkpoints)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INGEST_PERIOD)).start()
