"""Structured log lines and the daily log index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.functions import text as X
from articleflow.schemas import LOG


def log_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw lines (``value``) of the log files in a landing folder."""
    reader = spark.readStream if stream else spark.read
    return reader.schema("value string").format("text").load(path)


def log_stream_source(spark: SparkSession, path: str) -> DataFrame:
    """Decoded JSON-lines log files of a landing folder, as a stream; broken lines are left out."""
    return decode_logs(log_lines(spark, path, stream=True))


def _judged(lines: DataFrame) -> DataFrame:
    """Lines with ``log`` (the known fields) and ``fields`` (all fields as variants; null where a line is no object)."""
    return lines.select("value", F.from_json("value", LOG).alias("log"),
                        F.from_json("value", "map<string,variant>").alias("fields"))


def decode_logs(lines: DataFrame) -> DataFrame:
    """Log records: the known fields, and ``extra`` with all others as variants.

    A known field whose value has another type than it should is null and keeps its value in ``extra``. Lines that are
    no JSON object are left out (see ``broken_lines``).
    """
    def known(name: Column, value: Column) -> Column:
        taken = F.lit(False)
        for field in LOG.fields:
            taken |= (name == field.name) & F.col(f"log.{field.name}").isNotNull()
        return ~taken & value.isNotNull()

    records = _judged(lines).filter("fields is not null")
    return records.select("log.*", F.map_filter("fields", known).alias("extra"))


def broken_lines(lines: DataFrame) -> DataFrame:
    """Lines (``value``) that are neither blank nor a JSON object."""
    return _judged(lines).filter("fields is null").select("value").filter(
        ~X.blank(F.col("value")))


def daily_log_index(logs: DataFrame, arrived_at: Column, parsed_type: str = "map<string,string>") -> DataFrame:
    """Logs with a JSON message parsed into ``parsed``, a filled timestamp, and their index day.

    The day is that of the arrival, as index names are; the record's own timestamp is kept as it is.
    """
    is_json = F.col("message").rlike(r"^\{.*\}$")
    return (
        logs.withColumn("parsed", F.when(is_json, F.from_json("message", parsed_type)))
        .withColumn("timestamp", F.coalesce("timestamp", F.date_format(arrived_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))
        .withColumn("day", F.date_format(arrived_at, "yyyy.MM.dd"))
    )


def write_log_index(index: DataFrame, path: str, batch_id: int | None = None, run: str = "run") -> None:
    """Append to the index; with a batch id, write (or replace) what this batch of this run indexed."""
    if batch_id is None:
        index.write.mode("append").partitionBy("day").parquet(path)
    else:
        index.write.mode("overwrite").partitionBy("day").parquet(f"{path}/run={run}/batch_id={batch_id}")
