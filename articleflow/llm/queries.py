"""The registered queries of this subpackage, each over its whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from articleflow.llm import (
    alignment, ann, bag_search, chat, decontam, licenses, line_dedup, lm, near_dup, packing, sql, token_index, toxicity,
    warc,
)
from articleflow.session import scratch

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_licenses", sql.licenses())
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op2_line_dedup", sql.LINE_DEDUP)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


@query("op3_token_index")
def op3_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = token_index.write_store(docs, scratch(spark, "tokens"))
    keys = docs.select("doc_id").filter("doc_id is not null").distinct()
    return token_index.digest(store, token_index.locate(store, keys).unionByName(token_index.keyless(store)))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digest(packing.packed(table(spark, sf_dir, "documents")))


@query("op5_nearest")
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, network).drop("text_hash")


@query("op7_near_dup", sql.NEAR_DUP)
def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_dup_components(table(spark, sf_dir, "documents"), size=2)


@query("op8_decontamination", sql.DECONTAMINATION)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(
        decontam.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op9_lm_score")
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


@query("op10_chat_tree")
def op10_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.formatted_conversations(turns.unionByName(extra))[1]


@query("op11_capture_index", sql.CAPTURES)
def op11_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = warc.write_archive(pages, scratch(spark, "warc"))
    return warc.digest(warc.read_records(archive, warc.lookup(archive, pages), with_payload=False))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_counts(table(spark, sf_dir, "documents"))[0]


@query("op13_bag_search", sql.RANKED)
def op13_bag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
