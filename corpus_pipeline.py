"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again for the next one.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of their input. The
stages share executors, whose memory grows with each: texts go to Python workers in small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions.text import strip
from articleflow.llm import decontam, line_dedup, near_dup, packing, toxicity
from articleflow.llm.common import fresh
from articleflow.session import cut, text_batches


# Words whose ids a worker remembers while it packs: the executors' memory has grown over the stages before.
PACKING_WORDS = 150_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not predict as toxic."""
    network = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    with text_batches(spark):
        return toxicity.drop_toxic(docs, network)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stood earlier; one that has only white space left goes.

    ``n_chars``, where there is one, follows the text.
    """
    (mark,) = fresh(docs, "n_removed_lines")
    with text_batches(spark):
        done = line_dedup.dedup_lines(docs)
    touched = F.col(mark) > 0
    done = done.filter(~touched | (strip(F.col("text")) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(touched, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def remove_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    with text_batches(spark):
        return near_dup.drop_near_dups(docs, size=5, percent=80)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in passages of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 1024 tokens, one row per piece."""
    with text_batches(spark):
        return cut(packing.piece_digest(packing.packed(docs, memory_words=PACKING_WORDS)))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", remove_repeated_lines),
    ("near-duplicates", remove_near_dups),
    ("decontamination", remove_contaminated),
    ("packing", pack),
]

# Trained weights decide the first stage, and tokens the last: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
