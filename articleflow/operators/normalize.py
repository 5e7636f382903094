"""Entries to articles: normalisation, envelopes, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow import constants as C
from articleflow.functions import text as X
from articleflow.schemas import ARTICLE, ENVELOPE


def normalize_articles(entries: DataFrame, as_of: Column) -> DataFrame:
    """Feed entries (feed_url, link, title, summary, author, published, tags) to article records.

    The word count is taken on the raw summary, the content is its text. A present but empty tag list stays empty.
    Further columns of the entries, such as their position in the feed, are kept.
    """
    known = ("feed_url", "link", "title", "summary", "author", "published", "tags")
    summary = F.coalesce(F.col("summary"), F.lit(""))
    return entries.select(
        X.url_uuid(F.col("link")).alias("article_id"),
        F.col("link").alias("url"),
        "title",
        X.html_to_text(summary).alias("content"),
        X.source_name(F.col("feed_url")).alias("source"),
        F.coalesce(F.col("author"), F.lit(C.DEFAULT_AUTHOR)).alias("author"),
        X.lenient_timestamp(F.col("published"), as_of).alias("published_date"),
        as_of.alias("scraped_at"),
        F.coalesce(F.col("tags"), F.array(F.lit(C.DEFAULT_CATEGORY))).alias("categories"),
        F.struct(F.size(X.words(summary)).alias("word_count")).alias("metadata"),
        *[c for c in entries.columns if c not in known],
    )


def parse_messages(messages: DataFrame, schema: T.StructType = ARTICLE) -> DataFrame:
    """JSON text column ``value`` to ``record`` plus ``_corrupt`` (the text of a malformed message, else null).

    Exploded from an array of one: a filter on a column would be pushed down and parse the text once per use of it.
    """
    layout = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    others = [c for c in messages.columns if c != "record"]
    record = F.explode(F.array(F.from_json("value", layout, options))).alias("record")
    return messages.select(*others, record).withColumn("_corrupt", F.col("record._corrupt"))


def judged_messages(messages: DataFrame, schema: T.StructType = ARTICLE,
                    required: tuple[str, ...] | None = None) -> DataFrame:
    """Messages with ``record`` and ``reason``: null for a good record, else why the message is a dead letter.

    A record without one of the ``required`` fields is a dead letter too (an article needs its id and url), as are
    empty messages.
    """
    if required is None:
        required = ("article_id", "url") if schema is ARTICLE else ()
    parsed = parse_messages(messages, schema)
    empty = X.blank(F.col("value"))
    reason = F.when(empty, "empty").when(F.col("_corrupt").isNotNull() | F.col("record").isNull(), "malformed")
    for name in required:
        reason = reason.when(F.col(f"record.{name}").isNull(), f"no {name}")
    return parsed.withColumn("reason", reason)


def good_records(judged: DataFrame, schema: T.StructType = ARTICLE) -> DataFrame:
    return judged.filter("reason is null").select(*[f"record.{field.name}" for field in schema.fields])


def dead_letters(judged: DataFrame) -> DataFrame:
    """(value, reason) of the messages that are no good records."""
    return judged.filter("reason is not null").select("value", "reason")


def quarantine_bad_records(messages: DataFrame, schema: T.StructType = ARTICLE,
                           required: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good records, dead letters): malformed messages never stop the flow; every message is in one of the two."""
    judged = judged_messages(messages, schema, required)
    return good_records(judged, schema), dead_letters(judged)


def unwrap_envelope(messages: DataFrame) -> DataFrame:
    """Messages ``{article, chunks}`` or bare articles to (article, chunks) rows; empty messages are skipped."""
    good, _ = quarantine_bad_records(messages, ENVELOPE)
    bare = F.struct(*[F.col(f.name) for f in ARTICLE.fields])
    article = F.when(F.col("article").isNotNull(), F.col("article")).when(
        F.coalesce(*[F.col(f.name).cast("string") for f in ARTICLE.fields[:4]]).isNotNull(), bare
    )
    return (
        good.select(article.alias("article"), F.coalesce("chunks", F.array()).alias("chunks"))
        .filter(F.col("article").isNotNull())
        .withColumn("article", F.col("article").withField("title", F.coalesce("article.title", F.lit(C.DEFAULT_TITLE))))
    )


def article_rows(articles: DataFrame, created_at: Column) -> DataFrame:
    """Article records to the layout of the ``articles`` table."""
    return articles.select(
        F.col("article_id").alias("id"),
        "url",
        F.coalesce("title", F.lit(C.DEFAULT_TITLE)).alias("title"),
        "source",
        "author",
        "published_date",
        "content",
        F.coalesce("metadata.word_count", F.lit(0)).alias("word_count"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        created_at.alias("created_at"),
    )
