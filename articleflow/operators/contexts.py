"""Context and source lists per query. A group is one query's few hits, in rank order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow import constants as C
from articleflow.functions import text as X


def _ordered(key: str, *fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(key, *fields)))


def distinct_sources(hits: DataFrame) -> DataFrame:
    """Distinct sources per query, by best rank."""
    listed = hits.groupBy("query_id").agg(_ordered("rank", "source").alias("_hits"))
    return listed.select("query_id", F.array_distinct("_hits.source").alias("sources"))


def build_context(hits: DataFrame) -> DataFrame:
    """(query_id, context, sources): non-empty texts in rank order, and their sources once each."""
    content = F.col("content") if "content" in hits.columns else F.lit("")
    picked = hits.withColumn("_text", X.first_non_empty(F.col("text"), content)).filter(F.col("_text") != "")
    listed = picked.groupBy("query_id").agg(_ordered("rank", "_text", "source").alias("_hits"))
    return listed.select(
        "query_id",
        F.array_join("_hits._text", C.BLOCK_SEPARATOR).alias("context"),
        F.array_distinct("_hits.source").alias("sources"),
    )


def web_context(hits: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(query_id, context, sources) of enriched external hits: numbered blocks and ``source - link`` labels.

    ``max_chars`` keeps only the head of each content; without it blocks hold whole contents.
    """
    def text(name: str) -> Column:
        return F.coalesce(name, F.lit(""))

    content = text("content") if max_chars is None else F.substring(text("content"), 1, max_chars)
    block = F.concat(
        F.lit("[Article "), F.col("ordinal").cast("string"), F.lit("]\nTitle: "), text("title"),
        F.lit("\nSource: "), text("source"), F.lit("\nLink: "), text("link"),
        F.lit("\nContent: "), content, F.lit("...\n"),
    )
    label = F.concat_ws(" - ", "source", "link")
    listed = hits.withColumn("_block", block).withColumn("_label", label).groupBy("query_id").agg(
        _ordered("ordinal", "_block", "_label").alias("_hits")
    )
    return listed.select(
        "query_id",
        F.array_join("_hits._block", C.BLOCK_SEPARATOR).alias("context"),
        F.col("_hits._label").alias("sources"),
    )


def parallel_context(requests: DataFrame, local_hits: DataFrame, external: DataFrame) -> DataFrame:
    """(query_id, context, cards) of the streaming route.

    Local texts, web lines and paper lines, separated by blank lines; cards list web hits, then papers.
    """
    paper = F.col("source_no") == C.EXTERNAL_SOURCES.index("papers")
    line = F.when(
        paper, F.concat(F.lit("Paper: "), "title", F.lit(" | Summary: "), "summary")
    ).otherwise(F.concat(F.lit("Source: "), "source", F.lit(" | Content: "), "summary"))
    card = F.struct(
        "title", F.col("link").alias("url"),
        F.when(paper, C.PAPER_CARD_SOURCE).otherwise(F.col("source")).alias("source"),
    )
    shaped = external.select("query_id", "source_no", "rank", paper.alias("paper"), line.alias("line"), card.alias("card"))
    outside = shaped.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("source_no", "rank", "paper", "line", "card"))).alias("_hits")
    ).select(
        "query_id",
        F.array_join(F.transform(F.filter("_hits", lambda h: ~h["paper"]), lambda h: h["line"]), "\n").alias("web"),
        F.array_join(F.transform(F.filter("_hits", lambda h: h["paper"]), lambda h: h["line"]), "\n").alias("papers"),
        F.col("_hits.card").alias("cards"),
    )
    local = build_context(local_hits).select("query_id", F.col("context").alias("local"))
    empty = F.lit("")
    return (
        requests.select("query_id").join(local, "query_id", "left").join(outside, "query_id", "left")
        .select(
            "query_id",
            F.concat_ws(
                "\n\n", F.coalesce("local", empty), F.coalesce("web", empty), F.coalesce("papers", empty)
            ).alias("context"),
            F.coalesce("cards", F.array().cast("array<struct<title:string,url:string,source:string>>")).alias("cards"),
        )
    )
