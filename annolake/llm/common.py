"""Helpers shared by the operators: written intermediate tables and word rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annolake.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a maximal run without ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


#: Spark's setting for the rows that go to a Python worker at a time.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, batch: int | None) -> Iterator[None]:
    """For the jobs that run meanwhile: so many rows at most go to a Python worker at a time."""
    before = spark.conf.get(_BATCH)
    if batch:
        spark.conf.set(_BATCH, str(min(batch, int(before)) if int(before) > 0 else batch))
    try:
        yield
    finally:
        if batch:
            spark.conf.set(_BATCH, before)


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder and read back.

    Cuts the lineage so that a lost executor costs no earlier work, and gives
    the optimizer the table's size, on which it decides about broadcasts.
    ``batch``: for this job, so many rows at most go to a Python worker at a time;
    for rows that hold whole texts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/annolake-llm/{name}-{uuid.uuid4().hex}"
    with small_batches(spark, batch):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(spark: SparkSession) -> int:
    """In how many pieces the cluster wants a shuffle of this job."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else left."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null and blank texts have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
