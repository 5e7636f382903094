"""Repeat suppression on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow import constants as C
from articleflow.operators.dedup import arrival_order, banded, first_arrivals
from articleflow.operators.joins import salted_join, small_side
from articleflow.operators.tables import drop_partitions_before, read_or_empty
from articleflow.session import cut

_STORE = "bucket string, expires_at timestamp, expires_day date, run string, batch_id bigint"


def stream_url_dedup(articles: DataFrame, event_time: str = "scraped_at", horizon: str = "7 days") -> DataFrame:
    """A streaming frame without exact repeats; state is dropped ``horizon`` after an article was seen."""
    return articles.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["article_id"])


def near_dup_batch(batch: DataFrame, store: str, batch_id: int, order: list[str], as_of: Column,
                   ttl_seconds: int = C.FINGERPRINT_TTL_SECONDS, run: str = "run") -> DataFrame:
    """Survivors of one micro-batch against the remembered fingerprints and each other; remembers them.

    The store holds the buckets of kept articles, partitioned by expiry day, run and batch. Days that have expired at
    ``as_of`` are not read, and are deleted once the batch is written. A replayed batch ignores its own earlier
    fingerprints and overwrites them; another run's batches are others.
    """
    spark = batch.sparkSession
    batch = batch.dropDuplicates(order)  # at-least-once delivery may repeat a message within the batch
    today = F.to_date(as_of)
    store_rows = read_or_empty(spark, store, _STORE).filter(
        (F.col("expires_day") >= today) & (F.col("expires_at") > as_of)
        & ~((F.col("run") == run) & (F.col("batch_id") == batch_id))
    )
    items = cut(banded(batch, [arrival_order(order).alias("_order")]))
    slots = items.select("_order", F.explode("buckets").alias("bucket"))
    # The store is scanned once and reduced to the batch's own buckets before anything is shuffled back.
    asked = small_side(slots.select("bucket").distinct())
    taken = store_rows.select("bucket").join(asked, "bucket", "left_semi").distinct()
    known = salted_join(slots, taken, ["bucket"], ["_order"]).select("_order").distinct()
    kept = cut(first_arrivals(cut(items.join(known, "_order", "left_anti")), "_order"))
    expires = as_of + F.expr(f"INTERVAL {ttl_seconds} SECONDS")
    (
        slots.join(kept, "_order", "left_semi")
        .select("bucket", expires.alias("expires_at"), F.to_date(expires).alias("expires_day"),
                F.lit(run).alias("run"), F.lit(batch_id).cast("bigint").alias("batch_id"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("expires_day", "run", "batch_id").parquet(store)
    )
    drop_partitions_before(spark, store, "expires_day", str(spark.range(1).select(today.alias("day")).first()["day"]))
    dropped = cut(items.select("_order").join(kept, "_order", "left_anti"))
    ordered = batch.withColumn("_order", arrival_order(order))
    return ordered.join(small_side(dropped), "_order", "left_anti").drop("_order")
