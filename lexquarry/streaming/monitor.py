"""Extensions, as the flows themselves are batch: windowed monitoring of an interaction log, incremental ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(log: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, by, n, total: works on a table and, with a watermark, on a stream."""
    rows = log.withColumn(ts, F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    g = rows.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), by, "n", "total")


def ingest(stream: DataFrame, handle, checkpoint: str, once: bool = True):
    """New rows of a file stream to handle(batch, id); resumes from the checkpoint."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
