"""External hits: capped per source, merged in source order, enriched with page bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow import constants as C
from articleflow.operators.joins import first_per_key, salted_join, small_side
from articleflow.session import cut


def external_hits(tables: dict[str, DataFrame], caps: dict[str, int], as_of: Column) -> DataFrame:
    """Landed hits (query_id, rank, title, link, source, summary[, published]) of several sources in one layout.

    Each source contributes its first ``caps`` hits per query; news keeps its publisher, the others carry their
    source's name. Sources are numbered in their fixed order.
    """
    parts = []
    for number, name in enumerate(C.EXTERNAL_SOURCES):
        if name not in tables:
            continue
        hits = first_per_key(tables[name], ["query_id"], [F.col("rank").asc()], caps[name])
        label = F.lit(C.HIT_SOURCE_NAMES[name])
        publisher = F.coalesce("source", label) if name == "news" and "source" in hits.columns else label
        part = hits.select(
            "query_id", F.lit(number).alias("source_no"), "rank", "title", "link", publisher.alias("source"),
            F.coalesce("summary", F.lit("")).alias("summary"),
            *([F.coalesce(F.col("published"), as_of).alias("published")]
              if name == "news" and "published" in hits.columns else []),
        )
        parts.append(part)
    return union_sources(parts)


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Hit lists one after the other, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merged_top_n(hits: DataFrame, n: int = C.MERGED_HITS) -> DataFrame:
    """The first ``n`` hits per query in source order, numbered from 1 in ``ordinal``."""
    return first_per_key(hits, ["query_id"], [F.col("source_no").asc(), F.col("rank").asc()], n, "ordinal")


def enrich_hits(hits: DataFrame, pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Hits with ``content``: the page body (link, body), the summary where there is none.

    ``max_chars`` keeps only the head of each body; without it the whole body is content.
    """
    hits = cut(hits)
    body = F.col("body") if max_chars is None else F.substring("body", 1, max_chars)
    heads = pages.select("link", body.alias("_head"))
    wanted = heads.join(small_side(hits.select("link").distinct()), "link", "left_semi")
    bodies = first_per_key(wanted, ["link"], [F.col("_head").asc_nulls_last()])
    joined = salted_join(hits, bodies, ["link"], ["query_id", "ordinal"], "left")
    return joined.withColumn("content", F.coalesce(F.nullif("_head", F.lit("")), "summary")).drop("_head")
