"""Audit events: read, append by day, filter, retire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annolake.schemas import AUDIT_EVENTS


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Day files holding a JSON array each; files that are not JSON give no events."""
    return (spark.read.schema(AUDIT_EVENTS).option("multiLine", True)
            .option("mode", "DROPMALFORMED").json(path))


def event_date(timestamp: Column) -> Column:
    """Day of an ISO time stamp."""
    return F.substring(timestamp.cast("string"), 1, 10)


def append_events(events: DataFrame, path: str) -> None:
    """Append to the event table, one folder per day."""
    (events.withColumn("event_date", event_date(F.col("timestamp")))
     .write.mode("append").partitionBy("event_date").parquet(path))


def filter_events(events: DataFrame, start: str | None = None, end: str | None = None,
                  event_type: str | None = None, user: str | None = None,
                  status: str | None = None) -> DataFrame:
    """Inclusive bounds compared as text, exact type, user and status.

    Where the table is kept by day, the bounds prune its folders.
    """
    if start:
        events = events.filter(F.col("timestamp") >= start)
    if end:
        events = events.filter(F.col("timestamp") <= end)
    if "event_date" in events.columns:
        if start:
            events = events.filter(F.col("event_date") >= start[:10])
        if end:
            events = events.filter(F.col("event_date") <= end[:10])
    for column, wanted in (("event_type", event_type), ("user", user), ("status", status)):
        if wanted:
            events = events.filter(F.col(column) == wanted)
    return events


def retained(events: DataFrame, before: str | None) -> DataFrame:
    """Events kept when all before a time are cleared; none kept without a time."""
    return events.filter(F.col("timestamp") >= before) if before else events.limit(0)


def retire_events(spark: SparkSession, path: str, target: str, before: str | None) -> None:
    """Write the retained events to a new table; days are copied, the source stays readable."""
    events = spark.read.parquet(path)
    if before:
        events = events.filter(F.col("event_date") >= before[:10])
    (retained(events, before).write.mode("overwrite").partitionBy("event_date").parquet(target))
