"""Log lines to the daily index, continuously."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from articleflow.operators.tables import replace_batch
from articleflow.session import cut, scratch_space
from articleflow.sources.logs import (
    broken_lines, daily_log_index, decode_logs, log_lines, log_stream_source, write_log_index,
)


def start_log_index(spark: SparkSession, landing: str, index: str, checkpoint: str, once: bool = False,
                    arrived_at: Column | None = None, broken: str | None = None) -> StreamingQuery:
    """The index of all lines that land. With ``broken``, lines that are no JSON object go to that table.

    The index alone is a plain file sink. Two tables are written batch by batch, each below ``run`` and ``batch_id``,
    so that a replayed batch replaces what it wrote, on whichever day it arrived.
    """
    arrival = F.current_timestamp() if arrived_at is None else arrived_at
    if broken is None:
        rows = daily_log_index(log_stream_source(spark, landing), arrival)
        writer = (
            rows.writeStream.format("parquet").outputMode("append").partitionBy("day")
            .option("path", index).option("checkpointLocation", checkpoint)
        )
        return (writer.trigger(availableNow=True) if once else writer).start()

    def step(batch: DataFrame, batch_id: int) -> None:
        with scratch_space(batch.sparkSession):
            run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "run"
            lines = cut(batch)
            write_log_index(daily_log_index(decode_logs(lines), arrival), index, batch_id, run)
            replace_batch(broken_lines(lines), broken, batch_id, run)

    writer = log_lines(spark, landing, stream=True).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def level_windows(logs: DataFrame, width: str = "1 hour", lateness: str = "1 hour", event_time: str = "ts") -> DataFrame:
    """Entries per service, level and tumbling event-time window of a stream, each window reported once it is closed.

    A window is closed when the newest event time so far, less ``lateness``, has passed its end; state of closed
    windows is dropped, and rows that belong to them are late and do not count.
    """
    return (
        logs.withWatermark(event_time, lateness).groupBy(F.window(event_time, width), "service", "level").count()
        .select(F.col("window.start").alias("window_start"), "service", "level", F.col("count").alias("n"))
    )
