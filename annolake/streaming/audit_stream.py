"""Audit events appended by day as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from annolake.sources.audit import event_date, filter_events


def stream_events(events: DataFrame, **filters) -> DataFrame:
    """Filtered events with their day; ``filters`` as for ``filter_events``."""
    return filter_events(events, **filters).withColumn("event_date", event_date(F.col("timestamp")))


def append_by_day(events: DataFrame, path: str, checkpoint: str, once: bool = False):
    writer = (events.writeStream.format("parquet").outputMode("append").partitionBy("event_date")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()
