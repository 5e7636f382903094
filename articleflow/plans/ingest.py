"""Batch ingest: landed entries to the article and chunk tables in one go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from articleflow.operators.dedup import near_dup_filter
from articleflow.operators.embedding import Embedder
from articleflow.operators.normalize import normalize_articles
from articleflow.operators.tables import exact_url_dedup
from articleflow.session import cut
from articleflow.streaming.ingest import chunk_rows


def ingest_entries(entries: DataFrame, as_of: Column, order: list[str],
                   load: Callable[[], Embedder] | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, embedded chunks) of feed entries after exact and near de-duplication."""
    articles = cut(exact_url_dedup(normalize_articles(entries, as_of), order))
    unique = cut(near_dup_filter(articles, order))
    return unique, chunk_rows(unique, load)
