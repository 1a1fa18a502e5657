"""Streaming ingestion into a keyed Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import first_by_key


def ingest(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, watermark: str = "1 hour") -> StreamingQuery:
    """Append a stream's rows to a Parquet table, of rows with one key the first only.

    `order` is the event time. State keeps the keys of the watermark's span; a batch repeated after a failure writes
    its own folder again, so no row is there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        first_by_key(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    unique = stream.withWatermark(order, watermark).dropDuplicatesWithinWatermark([key])
    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, length: str, *by: str, watermark: str = "1 hour") -> DataFrame:
    """Rows and, by key, counts per tumbling window; late rows are dropped past the watermark."""
    return stream.withWatermark(time, watermark).groupBy(F.window(time, length), *by).agg(F.count(F.lit(1)).alias("n"))
