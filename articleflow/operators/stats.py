"""Counts and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.operators.joins import first_per_key


def source_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source").agg(F.count("*").alias("n_articles"))


def store_counts(stores: dict[str, DataFrame]) -> DataFrame:
    """(store, n) per table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n") for name, df in stores.items()]
    return reduce(DataFrame.unionByName, parts)


def feed_health(checks: DataFrame) -> DataFrame:
    """Checks (feed, ok, elapsed, entries) to one row per feed and one for all (feed null)."""
    return checks.rollup("feed").agg(
        F.count("*").alias("checks"),
        F.count_if("ok").alias("working"),
        F.round(100.0 * F.count_if("ok") / F.count("*"), 1).alias("success_rate"),
        F.round(F.avg("elapsed"), 6).alias("avg_elapsed"),
        F.sum("entries").alias("entries"),
    )


def log_level_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("day", "service", "level").agg(F.count("*").alias("n"))


def trending_topics(articles: DataFrame, top_n: int = 3) -> DataFrame:
    """The most frequent categories per publication day."""
    counted = (
        articles.select(F.to_date("published_date").alias("day"), F.explode("categories").alias("category"))
        .groupBy("day", "category").agg(F.count("*").alias("n"))
    )
    return first_per_key(counted, ["day"], [F.col("n").desc(), F.col("category").asc()], top_n, "rank")


def query_log(responses: DataFrame, elapsed_ms: Column, created_at: Column) -> DataFrame:
    """Rows of the query-log table."""
    return responses.select(
        F.col("query").alias("query_text"), elapsed_ms.cast("int").alias("response_time_ms"),
        created_at.alias("created_at"),
    )


def latency_summary(log: DataFrame) -> DataFrame:
    """Per day: queries, mean, median and 95th percentile of the response time (mergeable summaries)."""
    return log.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg("response_time_ms"), 6).alias("avg_ms"),
        F.percentile_approx("response_time_ms", 0.5, 10000).alias("p50_ms"),
        F.percentile_approx("response_time_ms", 0.95, 10000).alias("p95_ms"),
        F.max("response_time_ms").alias("max_ms"),
    )
