"""Annotation tables: extraction views and flat exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annolake.functions.color import CYAN, color_lit, rgb_text, text_color
from annolake.functions.geometry import height, width
from annolake.functions.metrics import font_for_table
from annolake.functions.text import with_clean_text

KEYS = ("study_id", "doc_id", "page", "annot_idx")


def _keys(df: DataFrame) -> list[str]:
    return [c for c in KEYS if c in df.columns]


def extract(annotations: DataFrame) -> DataFrame:
    """Cleaned text and top-left corner of every annotation that has a text."""
    rows = with_clean_text(annotations)
    return rows.filter(F.col("content") != "").select(
        *_keys(annotations), "content", F.col("rect.x0").alias("x0"), F.col("rect.y0").alias("y0"))


def extract_full(annotations: DataFrame, run_ts: str | None = None) -> DataFrame:
    """As ``extract`` with author (Unknown where none), full box and type."""
    rows = with_clean_text(annotations)
    out = rows.filter(F.col("content") != "").select(
        *_keys(annotations), F.coalesce("author", F.lit("Unknown")).alias("author"), "content",
        "rect", "type")
    return out if run_ts is None else out.withColumn("timestamp", F.lit(run_ts))


def position_table(extracted: DataFrame) -> DataFrame:
    """Page, Text, X, Y."""
    return extracted.select(*(c for c in ("doc_id", "annot_idx") if c in extracted.columns),
                            F.col("page").alias("Page"), F.col("content").alias("Text"),
                            F.col("x0").alias("X"), F.col("y0").alias("Y"))


def author_table(extracted: DataFrame, include_coordinates: bool = False) -> DataFrame:
    """Page, Author, Content, Type, and the box when asked."""
    box = [F.col(f"rect.{c}").alias(n) for c, n in
           (("x0", "X1"), ("y0", "Y1"), ("x1", "X2"), ("y1", "Y2"))] if include_coordinates else []
    return extracted.select(*(c for c in ("doc_id", "annot_idx") if c in extracted.columns),
                            F.col("page").alias("Page"), F.col("author").alias("Author"),
                            F.col("content").alias("Content"), F.col("type").alias("Type"), *box)


def style_table(annotations: DataFrame) -> DataFrame:
    """FreeText boxes with colours, border, box, font and dates in 28 columns.

    Columns the table lacks (``border_width, border_style, subject,
    creation_date, modification_date``) take their defaults.
    """
    def optional(name: str, default) -> Column:
        return F.coalesce(name, F.lit(default)) if name in annotations.columns else F.lit(default)

    rows = annotations.filter(F.col("type") == "FreeText").select(
        "*", text_color(F.col("da"), F.col("stroke")).alias("_text"),
        F.coalesce("fill", color_lit(CYAN)).alias("_fill"),
        F.coalesce("stroke", color_lit((0, 0, 0))).alias("_border"),
        font_for_table(F.col("da")).alias("_font"))
    colors = []
    for column, title, parts in (("_text", "Text_Color", "Text_Color"),
                                 ("_fill", "Background_Color", "Background"),
                                 ("_border", "Border_Color", "Border")):
        colors.append(rgb_text(F.col(column)).alias(title))
        colors += [(F.col(f"{column}.{c}") * 255).cast("int").alias(f"{parts}_{c.upper()}")
                   for c in "rgb"]
    box = F.col("rect")
    return rows.select(
        *(c for c in ("study_id", "doc_id", "annot_idx") if c in annotations.columns),
        F.col("page").alias("Page"), F.col("content").alias("Content"), *colors,
        optional("border_width", 1.0).alias("Border_Width"),
        optional("border_style", "S").alias("Border_Style"),
        *(box[c].alias(f"Position_{c.upper()}") for c in ("x0", "y0", "x1", "y1")),
        width(box).alias("Width"), height(box).alias("Height"),
        F.col("_font.name").alias("Font_Name"), F.col("_font.size").alias("Font_Size"),
        F.coalesce("author", F.lit("")).alias("Author"), optional("subject", "").alias("Subject"),
        optional("creation_date", "").alias("Creation_Date"),
        optional("modification_date", "").alias("Modification_Date"))


def write_table(df: DataFrame, path: str, output_format: str = "parquet",
                by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Write as parquet, CSV or JSON, one folder per value of ``by``."""
    if output_format not in ("parquet", "csv", "json"):
        raise ValueError("format must be parquet, csv or json")
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    if output_format == "csv":
        writer = writer.option("header", True)
    writer.format(output_format).save(path)


def export_findings(findings: DataFrame, path: str, run_ts: str) -> None:
    """Findings as two CSV folders: details and the category by severity summary."""
    from annolake.operators.report import category_severity_summary, details_table

    details = details_table(findings, run_ts).drop("Original Annotation")
    write_table(details, f"{path}_details", "csv")
    write_table(category_severity_summary(findings).select(
        F.col("category").alias("Category"), F.col("severity").alias("Severity"),
        F.col("count").alias("Count"), F.col("percentage").alias("Percentage")),
        f"{path}_summary", "csv")
