"""Arriving annotations, checked as they come.

Every rule is decided inside the row, so the findings need no state: catalogue
look-ups are stream-static joins.  Unused datasets depend on all batches: a second
stream keeps the domains seen in each study as state, one entry for each domain and
study, and appends each to a table once; what the catalogue has beyond that table is
unused so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annolake.operators.classify import accepted, parse
from annolake.operators.rules import Catalog, CheckOptions, unused_datasets
from annolake.plans.check import check
from annolake.sources.tables import extract


def stream_findings(annotations: DataFrame, catalog: Catalog,
                    options: CheckOptions = CheckOptions(), dialect: str = "config") -> DataFrame:
    """Findings of a streaming annotation table."""
    return check(annotations, catalog, options, dialect=dialect).findings


def append_findings(findings: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Start appending findings to parquet; the checkpoint makes each file count once."""
    writer = (findings.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_seen(annotations: DataFrame, catalog: Catalog, patterns=None, dialect: str = "config") -> DataFrame:
    """Each domain that a streaming annotation table names, once for each study."""
    keys = [*catalog.study_keys, "domain"]
    rows = accepted(parse(extract(annotations), patterns, dialect, catalog.dm_names(), study_keys=catalog.study_keys))
    return rows.filter("domain is not null").select(*keys).dropDuplicates(keys)


def unused_so_far(spark: SparkSession, path: str, catalog: Catalog) -> DataFrame:
    """Datasets that no batch has named yet; ``path`` is where ``stream_seen`` was appended."""
    return unused_datasets(spark.read.parquet(path), catalog)
