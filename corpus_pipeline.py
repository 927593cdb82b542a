"""From raw documents to token files: quality, near duplicates, benchmark leaks, mix, ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the documents they keep, with the columns they came with.  ``run`` writes
every stage's result as Parquet under the shared folder and reads it again as the
next one's documents.  Empty tables and nulls pass as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annolake.llm import decontaminate, jaccard, mixing, quality, tokens
from annolake.llm.common import written
from annolake.llm.queries import POWERS, TOKENIZER, quality_labels, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return quality.keep(docs, quality_labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled with their calibrated probabilities."""
    return mixing.sample(docs, POWERS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files and read back: place, number, checksum."""
    return tokens.encode_corpus(docs, TOKENIZER)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]
#: Boosted trees, raked rates and the tokenizer have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
