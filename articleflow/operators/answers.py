"""Prompts, answers and the result cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow import constants as C
from articleflow.functions import text as X
from articleflow.operators.joins import first_per_key, salted_join, small_side
from articleflow.operators.routing import intent
from articleflow.session import once

RESPONSE_FIELDS = ("answer", "sources", "used_realtime", "reranked", "local_results_count", "query_processed")

PROMPT_HEAD = (
    "Answer the question from the passages below and from nothing else.\n"
    "Cite the passage behind every statement by its number, like [1], right after the statement.\n"
    "Give a short summary, the details as a list, one closing remark and the list of sources used.\n"
    "If the passages do not answer the question, say that they do not."
)


def prompt_rows(contexts: DataFrame) -> DataFrame:
    """Rows with query, context and sources to rows with ``numbered_sources`` and ``prompt``."""
    numbered = F.array_join(
        F.transform("sources", lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s)), "\n"
    )
    return contexts.withColumn("numbered_sources", numbered).withColumn(
        "prompt",
        F.concat(
            F.lit(PROMPT_HEAD), F.lit("\n\nPassages:\n"), "context", F.lit("\n\nSources:\n"), "numbered_sources",
            F.lit("\n\nQuestion:\n"), "query", F.lit("\n"),
        ),
    )


def stream_prompt(context: Column, query: Column) -> Column:
    """The shorter prompt of the streaming route."""
    return F.concat(F.lit("Context: "), context, F.lit("\n\nQuery: "), query)


def extractive_answer(context: Column) -> Column:
    """Built-in stand-in for a generator: the first context block."""
    return F.get(F.split(context, C.BLOCK_SEPARATOR), 0)


def greeting(assistant: str) -> str:
    return f"Hi! I'm {assistant} 👋 Ask me anything about AI, technology, startups, or software engineering."


def answer_rows(contexts: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]] | None = None) -> DataFrame:
    """Response records of routed contexts; a blank context gets the fixed apology.

    ``load`` returns a generator from prompts to answers, loaded once per task and fed Arrow batches.
    """
    if load is None:
        answer = extractive_answer(F.col("context"))
    else:
        @F.pandas_udf(T.StringType())
        def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for prompts in batches:
                yield pd.Series(model(prompts.tolist()))

        answer = once(generate)(F.col("prompt"))
    blank = X.blank(F.col("context"))
    rows = contexts if load is None else prompt_rows(contexts)
    return rows.select(
        "query_id", "query", "context",
        F.when(blank, C.NO_CONTEXT_ANSWER).otherwise(answer).alias("answer"),
        "sources", "used_realtime", "reranked", "local_results_count",
        F.col("query").alias("query_processed"),
    )


def smalltalk_rows(queries: DataFrame, assistant: str = "your technology assistant") -> DataFrame:
    """Fixed greeting responses of the smalltalk queries."""
    return queries.filter(intent(F.col("query")) == "smalltalk").select(
        "query_id", "query", F.lit("").alias("context"),
        F.lit(greeting(assistant)).alias("answer"),
        F.array().cast("array<string>").alias("sources"),
        F.lit(False).alias("used_realtime"), F.lit(False).alias("reranked"),
        F.lit(0).alias("local_results_count"), F.col("query").alias("query_processed"),
    )


def cache_put(responses: DataFrame, as_of: Column, ttl_seconds: int = C.CACHE_TTL_SECONDS) -> DataFrame:
    """Cache rows (cache_key, response, expires_at) of the responses with a non-blank context, one per query."""
    rows = responses.filter(~X.blank(F.col("context"))).select(
        X.cache_key(F.col("query")).alias("cache_key"),
        F.to_json(F.struct(*RESPONSE_FIELDS)).alias("response"),
        (as_of + F.expr(f"INTERVAL {ttl_seconds} SECONDS")).alias("expires_at"),
        "query_id",
    )
    return first_per_key(rows, ["cache_key"], [F.col("query_id").desc()]).drop("query_id")


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Requests with ``hit`` and the stored response; expired entries do not count.

    The cache is scanned for the requested keys only; popular queries repeat a key, hence the salted join.
    """
    keyed = requests.withColumn("cache_key", X.cache_key(F.col("query")))
    asked = keyed.select("cache_key").distinct()
    live = cache.filter(F.col("expires_at") > as_of).join(small_side(asked), "cache_key", "left_semi")
    live = first_per_key(live, ["cache_key"], [F.col("expires_at").desc(), F.col("response").asc()])
    found = salted_join(keyed, live.select("cache_key", "response"), ["cache_key"], ["query_id"], "left")
    return found.withColumn("hit", F.col("response").isNotNull())
