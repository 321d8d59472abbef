"""Structured Streaming: windowed counts with late data, and batch operators on micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n, total) of tumbling windows; on a stream, rows later than `late` are left out."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def on_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a batch operator on each micro-batch and write its rows under the batch's number, so that a batch run again
    replaces its own rows: exactly once, given the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
