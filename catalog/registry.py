"""Query registration and the inputs the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions import text as X
from articleflow.session import spread
from articleflow.sources.feeds import page_entries

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-02-01 00:00:00"
DOC_URL = "https://example.org/d/"
ITEM_URL = "https://example.org/b/"


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def iso(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_articles(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """``documents`` as articles, arriving one per minute in ``doc_id`` order. ``heavy`` spreads them over the cores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "source")
    docs = spread(docs) if heavy else docs
    url = F.concat(F.lit(DOC_URL), F.col("doc_id").cast("string"))
    arrived = F.expr("timestampadd(MINUTE, cast(doc_id as int), timestamp'2024-01-01 00:00:00')")
    return docs.select(
        "doc_id", X.url_uuid(url).alias("article_id"), url.alias("url"), F.col("lang").alias("title"),
        F.col("text").alias("content"), "source", F.lit("Unknown").alias("author"),
        arrived.alias("published_date"), arrived.alias("scraped_at"), F.array(F.lit("General")).alias("categories"),
        F.struct(F.size(X.words(F.col("text"))).alias("word_count")).alias("metadata"),
    )


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as normalised articles, published one per hour in ``page_id`` order."""
    articles = page_entries(spread(table(spark, sf_dir, "pages")))
    return articles.select(
        "page_id", X.url_uuid(F.col("link")).alias("article_id"), F.col("link").alias("url"), "title",
        X.html_to_text(F.col("summary")).alias("content"), X.source_name(F.col("feed_url")).alias("source"),
        F.expr("timestampadd(HOUR, cast(page_id as int), timestamp'2024-01-01 00:00:00')").alias("published_date"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` passages as search requests."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


SHORT_QUERIES = (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"),
                 ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name"))


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(table(spark, sf_dir, name))


def all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query log: all conversation turns, and short queries: customer, supplier, part and nation names."""
    log = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("turn-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("query_id"),
        F.col("text").alias("query"),
    )
    for name, key, text in SHORT_QUERIES:
        log = log.unionByName(table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{name}-"), F.col(key).cast("string")).alias("query_id"), F.col(text).alias("query")
        ))
    return log
