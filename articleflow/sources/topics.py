"""Article topics: JSON messages from Kafka or from a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from articleflow.operators.normalize import dead_letters, good_records, judged_messages, quarantine_bad_records
from articleflow.operators.tables import replace_batch
from articleflow.schemas import ARTICLE
from articleflow.session import cut, scratch_space


def message_stream(spark: SparkSession, source_format: str, options: dict[str, str]) -> DataFrame:
    """Streaming ``value`` texts. Kafka options carry ``subscribe`` and ``startingOffsets``; ``text`` reads files."""
    reader = spark.readStream.format(source_format).options(**options)
    if source_format == "kafka":
        return reader.load().select(F.col("value").cast("string").alias("value"))
    return reader.schema("value string").load()


def article_stream_source(spark: SparkSession, source_format: str, options: dict[str, str],
                          schema: T.StructType = ARTICLE) -> DataFrame:
    """Decoded article messages; malformed ones are left out (``start_article_sinks`` keeps them)."""
    good, _ = quarantine_bad_records(message_stream(spark, source_format, options), schema)
    return good


def start_article_sinks(messages: DataFrame, good: str, bad: str, checkpoint: str, schema: T.StructType = ARTICLE,
                        once: bool = False) -> StreamingQuery:
    """One stream, two tables: good records and dead letters (value, reason), both with ``run`` and ``batch_id``.

    Every message of a batch lands in exactly one of the two. A batch is judged once and written as partitions of its
    own, so a replayed batch overwrites only itself, in both tables.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        with scratch_space(batch.sparkSession):
            run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "run"
            judged = cut(judged_messages(batch, schema))
            replace_batch(good_records(judged, schema), good, batch_id, run)
            replace_batch(dead_letters(judged), bad, batch_id, run)

    writer = messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keyed_messages(articles: DataFrame, key: str = "source") -> DataFrame:
    """(key, value) rows for a topic. The sink places equal keys together; Spark does not shuffle for it."""
    return articles.select(F.col(key).alias("key"), F.to_json(F.struct(*articles.columns)).alias("value"))


def keyed_publish(articles: DataFrame, sink_format: str, options: dict[str, str], key: str = "source") -> None:
    """Write articles to a topic (``kafka``) or to a folder (``parquet``, ``json``)."""
    keyed_messages(articles, key).write.format(sink_format).options(**options).mode("append").save()
