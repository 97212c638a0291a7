"""Event-time aggregates with watermarks, and register deltas merged into a running total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_sums(events: DataFrame, time: str, key: str, measure: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum by window and key. On a stream, rows later than the watermark are dropped and closed windows leave the state."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "total")


def keep_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All windows as they stand after each micro-batch, written over those of the batch before."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(path)
    return windows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_totals(stream: DataFrame, path: str, checkpoint: str, keys: list[str], measure: str) -> StreamingQuery:
    """Each micro-batch's sums, written under its number: a batch that runs again replaces what it had written, so totals read
    with read_totals() count every row once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.sum(measure).alias("total")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_totals(spark, path: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("total").alias("total"))
