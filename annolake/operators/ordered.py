"""Ordered look-back over long sequences, in bounded pieces.

A window over one document runs in one task.  Here the sequence is cut into
chunks by a bounded number (page numbers, file blocks): the window runs inside
each chunk, one summary row per chunk carries the state across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

PAGES_PER_CHUNK = 4096


def page_chunk(page: Column, size: int = PAGES_PER_CHUNK) -> Column:
    return F.floor((page - 1) / size)


def with_previous(df: DataFrame, part: list[str], order: str, value: str, out: str,
                  chunk: Column) -> DataFrame:
    """Value of the row before, within ``part`` by ``order``; null on the first row.

    ``order`` must be unique within ``part``; ``value`` must not be null.
    """
    inside = Window.partitionBy(*part, "_chunk").orderBy(order)
    df = df.withColumn("_chunk", chunk).withColumn(out, F.lag(value).over(inside))
    ends = df.groupBy(*part, "_chunk").agg(F.max_by(value, order).alias("_last"))
    across = Window.partitionBy(*part).orderBy("_chunk")
    ends = ends.select(*part, "_chunk", F.lag("_last").over(across).alias("_carried"))
    return (df.join(ends, [*part, "_chunk"])
            .withColumn(out, F.coalesce(out, "_carried")).drop("_chunk", "_carried"))


def carry_forward(df: DataFrame, part: list[str], order: str, value: str, out: str,
                  chunk: Column) -> DataFrame:
    """Last value that is not null, up to and with the row, within ``part`` by ``order``."""
    inside = (Window.partitionBy(*part, "_chunk").orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("_chunk", chunk).withColumn(
        out, F.last(value, ignorenulls=True).over(inside))
    ends = df.groupBy(*part, "_chunk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    across = (Window.partitionBy(*part).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*part, "_chunk",
                       F.last("_last", ignorenulls=True).over(across).alias("_carried"))
    return (df.join(ends, [*part, "_chunk"])
            .withColumn(out, F.coalesce(out, "_carried")).drop("_chunk", "_carried"))
