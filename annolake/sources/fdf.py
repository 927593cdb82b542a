"""FDF text: lines that name a page and lines that hold contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annolake.operators.ordered import carry_forward


def read_fdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of FDF files: ``doc_id, block, pos, line``.

    Files are read in splits, not whole: ``block`` is the split's start in the
    file and ``pos`` rises inside it, which together order a file's lines.
    """
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("doc_id"),
                        F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("pos"),
                        # the reader keeps a line's bytes, here Latin-1
                        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"))


def fdf_contents(lines: DataFrame) -> DataFrame:
    """Contents with the page last named before them; none before the first page."""
    page = F.nullif(F.regexp_extract("line", r"(?U)/Page (\d+)/", 1), F.lit(""))
    text = F.nullif(F.regexp_extract("line", r"(?d)/Contents\((.*?)\)/", 1), F.lit(""))
    rows = lines.select("doc_id", "block", "pos", page.alias("_page"),
                        F.translate(text, "\r\n", "").alias("content"))
    rows = rows.filter("_page is not null or content is not null")
    rows = carry_forward(rows, ["doc_id"], "pos", "_page", "page", F.col("block"))
    return rows.filter("content is not null and page is not null").select(
        "doc_id", "block", "pos", F.col("page").try_cast("int").alias("page"), "content")
