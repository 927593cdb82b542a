"""The standardize jobs: export, library and colour-preserving variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annolake.functions import color as C
from annolake.functions.geometry import flip, rect
from annolake.functions.metrics import STANDARD_FONT
from annolake.functions.text import (DEFAULT_AUTHOR, HEADER_PATTERN, header_code, header_font_size,
                                     header_label, is_header, normalize_quotes, with_clean_text)
from annolake.operators.forms import bookmarks, headers, item_bookmarks, page_forms
from annolake.operators.layout import PAGE, align, resize
from annolake.operators.matching import match_positions
from annolake.schemas import document_key
from annolake.session import kept
from annolake.sources import xfdf

# Types that take neither border nor fill.
NOTE_TYPES = ("Text", "StrikeOut", "Caret", "Highlight", "Underline")


@dataclass(frozen=True)
class StandardizeOptions:
    """Job settings.  Pages in the skip lists are 1-based; colours of the palette
    targets are 0-255, all others 0-1."""

    author: str = DEFAULT_AUTHOR
    header_size: float = 12.0
    text_size: float = 10.0
    background: tuple[float, float, float] = (0.0, 1.0, 1.0)
    border: tuple[float, float, float] = (0.0, 0.0, 0.0)
    form_label: str = "Form_bookmarks"
    domain_label: str = "SDTM"
    header_pattern: str = HEADER_PATTERN
    auto_resize: bool = True
    max_width: float | None = 200.0
    max_height: float | None = 300.0
    resize_skip: object = None
    align: bool = True
    align_horizontal: bool = True
    align_vertical: bool = True
    horizontal_tolerance: float = 1.0
    vertical_tolerance: float = 10.0
    align_skip: object = None
    quotes: bool = True
    apply_colors: bool = True
    palette: str = "v3"
    red: tuple[int, int, int] = C.STANDARD_RED
    blue: tuple[int, int, int] = C.STANDARD_BLUE
    green: tuple[int, int, int] = C.STANDARD_GREEN

    @property
    def author_name(self) -> str:
        return self.author if self.author and self.author.strip() else DEFAULT_AUTHOR

    def standard(self, color: Column) -> Column:
        return C.standardize_color(color, self.palette, self.red, self.blue, self.green)


def export(annotations: DataFrame, options: StandardizeOptions = StandardizeOptions()) -> DataFrame:
    """The rows a standardized XFDF file holds.

    Alignment sees blank boxes too; then come text, colour, size, width and the change to
    a bottom origin.
    """
    rows = annotations.filter(F.col("type") == "FreeText")
    # the colour first: it is shorter than the strings it is read from, which then need not be dealt out
    source = C.text_color(F.col("da"), appearance=F.col("appearance_text"), policy="export")
    rows = rows.withColumn("source_color", source)
    boxes, rows = rows, with_clean_text(rows).filter(F.col("content") != "")
    if options.align:
        rows = align(rows, options.horizontal_tolerance, options.vertical_tolerance,
                     method="first_fit", skip=options.align_skip, numbered=False, pool=boxes)
    else:
        rows = rows.withColumn("aligned", F.col("rect"))
    if options.quotes:
        rows = rows.withColumn("content", normalize_quotes(F.col("content")))
    rows = rows.withColumn("text_color", options.standard(F.col("source_color")))
    rows = rows.withColumn("font_size", header_font_size(
        F.col("content"), options.header_size, options.text_size).cast("double"))
    if options.auto_resize:
        rows = resize(rows, "export", box="aligned", skip=options.resize_skip, cleaned=True,
                      font_size=F.col("font_size"))
    else:
        rows = rows.withColumn("resized", F.col("aligned")).withColumn("changed", F.lit(False))
    return rows.select(
        "study_id", "doc_id", "page", "annot_idx", F.lit(options.author_name).alias("author"),
        "content", "font_size", "source_color", "text_color",
        C.to_hex(F.col("text_color")).alias("text_hex"),
        C.to_hex(C.color_lit(options.background)).alias("fill_hex"),
        C.color_lit(options.border).alias("border_color"), F.col("resized").alias("rect"),
        flip(F.col("resized"), F.col("page_height")).alias("xfdf_rect"),
        (F.col("text_color") != F.col("source_color")).alias("recolored"),
        F.col("changed").alias("resized"))


def export_files(spark: SparkSession, source: str, target: str,
                 options: StandardizeOptions = StandardizeOptions(), pdf_name: Column | str = "document.pdf",
                 page_height: Column | float = 792.0, places: int = 4,
                 compression: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan the XFDF documents under ``source``, standardize them, write them under ``target``.

    Gives the list of written files and the elements that could not be used.
    Coordinates are written to ``places`` decimals.  The files are scanned once; alignment
    and the other steps read the parsed elements from the shared folder.  ``compression``
    (``gzip``) is that of the written files.
    """
    parsed = kept(xfdf.parse_elements(xfdf.read_elements(spark, source)), "xfdf-parsed")
    rows = export(xfdf.annotations_of(parsed, page_height), options)
    box = F.col("xfdf_rect")
    rows = rows.withColumn("xfdf_rect", rect(*(F.round(box[c], places) for c in ("x0", "y0", "x1", "y1"))))
    return xfdf.write_elements(rows, target, xfdf.document_texts(), pdf_name, compression), xfdf.rejected(parsed)


def style_by_type(df: DataFrame, options: StandardizeOptions, rule: str = "present") -> Column:
    """What each annotation type gets; ``older`` is the rule with black text and thin borders."""
    kind = F.col("type")
    none, no_color = F.lit(None), F.lit(None).cast("struct<r:double,g:double,b:double>")
    fill, border = C.color_lit(options.background), C.color_lit(options.border)
    black = C.color_lit((0, 0, 0))
    older = rule == "older"
    free = F.struct(
        F.col("font_size").alias("font_size"),
        F.lit("helv" if older else STANDARD_FONT).alias("font_name"),
        (black if older else F.col("text_color")).alias("text_color"),
        fill.alias("fill"), black.alias("stroke"),
        (F.lit(1.0) if older else none.cast("double")).alias("border_width"),
        (F.lit("S") if older else none.cast("string")).alias("border_style"))
    shape = F.struct(
        none.cast("double").alias("font_size"), none.cast("string").alias("font_name"),
        no_color.alias("text_color"), fill.alias("fill"), border.alias("stroke"),
        F.lit(2.0).alias("border_width"), F.lit("S").alias("border_style"))
    note = F.struct(
        none.cast("double").alias("font_size"), none.cast("string").alias("font_name"),
        no_color.alias("text_color"), no_color.alias("fill"), no_color.alias("stroke"),
        none.cast("double").alias("border_width"), none.cast("string").alias("border_style"))
    return F.when(kind == "FreeText", free).when(kind.isin(*NOTE_TYPES), note).otherwise(shape)


def standardize(annotations: DataFrame, options: StandardizeOptions = StandardizeOptions()
                ) -> DataFrame:
    """The library job's rows: style by type, box grown then aligned, header code and label."""
    rows = with_clean_text(annotations)
    rows = rows.withColumn("is_header", is_header(F.col("content")))
    rows = rows.withColumn("font_size", F.when(F.col("is_header"), F.lit(options.header_size))
                           .otherwise(F.lit(options.text_size)).cast("double"))
    rows = rows.withColumn("source_color", C.text_color(F.col("da"), F.col("stroke")))
    if options.auto_resize:
        rows = resize(rows, "standard", max_width=options.max_width, max_height=options.max_height,
                      skip=options.resize_skip, cleaned=True, font_size=F.col("font_size"))
    else:
        rows = rows.withColumn("resized", F.col("rect")).withColumn(
            "checked", F.lit(False)).withColumn("changed", F.lit(False))
    rows = rows.withColumnRenamed("rect", "old_rect").withColumnRenamed("resized", "rect")
    # what alignment deals out is short: a header's parts instead of its text, one colour of two
    pattern = options.header_pattern
    rows = rows.withColumn("domain", header_code(F.col("content"), pattern)).withColumn(
        "label", header_label(F.col("content"), pattern))
    if options.align:
        rows = align(rows, options.horizontal_tolerance, options.vertical_tolerance,
                     options.align_horizontal, options.align_vertical, "running_mean",
                     options.align_skip, numbered=False, pool=annotations)  # resizing moves no upper left corner
    else:
        rows = rows.select("*", F.lit(False).alias("h_moved"), F.lit(False).alias("v_moved"),
                           F.col("rect").alias("aligned"))
    rows = rows.withColumn("text_color", options.standard(F.col("source_color")))
    rows = rows.withColumn("style", style_by_type(rows, options))
    return rows.select(
        "study_id", "doc_id", "page", "annot_idx", "type",
        F.lit(options.author_name).alias("author"), "content", "is_header", "style",
        "source_color", "text_color", "old_rect", F.col("aligned").alias("rect"), "checked",
        F.col("changed").alias("resized"), "h_moved", "v_moved",
        "domain", "label")


def standardize_totals(rows: DataFrame, toc: DataFrame | None = None,
                       by: tuple[str, ...] | None = None) -> DataFrame:
    """Modified, headers, boxes checked and resized, moves, shapes and bookmarks."""
    shape = ~F.col("type").isin("FreeText", *NOTE_TYPES)
    free = F.col("type") == "FreeText"
    by = document_key(rows, *([] if toc is None else [toc])) if by is None else by
    out = rows.groupBy(*by).agg(
        F.count("*").alias("annotations_modified"), F.count("domain").alias("headers_found"),
        F.count_if(shape).alias("rectangles_styled"),
        F.count_if("checked").alias("textboxes_checked"),
        F.count_if("resized").alias("textboxes_resized"),
        F.count_if("h_moved").alias("annotations_aligned_horizontal"),
        F.count_if("v_moved").alias("annotations_aligned_vertical"),
        F.count_if(free & (F.col("text_color") != F.col("source_color")))
        .alias("colors_standardized"))
    if toc is None:
        return out
    figures = [c for c in out.columns if c not in by]
    entries = toc.groupBy(*by).agg(F.count("*").alias("bookmarks_created"))
    both = out.unionByName(entries, allowMissingColumns=True)
    return both.groupBy(*by).agg(
        *(F.sum(c).alias(c) for c in figures),
        F.coalesce(F.sum("bookmarks_created"), F.lit(0)).alias("bookmarks_created")
    ).filter("annotations_modified is not null")


def standard_bookmarks(rows: DataFrame, pages: DataFrame,
                       options: StandardizeOptions = StandardizeOptions()) -> DataFrame:
    return bookmarks(page_forms(pages), headers(rows, pattern=options.header_pattern),
                     options.form_label, options.domain_label)


def preserve_colors(annotations: DataFrame, author: str = DEFAULT_AUTHOR) -> DataFrame:
    """Earlier job: keep text colours (blue where none is known), recase, set sizes."""
    rows = with_clean_text(annotations, rule="simple")
    rows = rows.filter(F.col("content") != "")
    color = C.text_color(F.col("da"), F.col("stroke"), policy="preserve")
    rows = rows.withColumn("_color", F.coalesce(color, C.color_lit((0, 0, 1))))
    header = header_code(F.col("content")).isNotNull()
    return rows.select(
        *(c for c in PAGE if c in annotations.columns), "annot_idx", "rect",
        F.lit(author).alias("author"), F.col("content").alias("source_text"),
        F.when(header, F.col("content")).otherwise(F.upper("content")).alias("content"),
        header.alias("is_header"), F.when(header, 12).otherwise(10).alias("font_size"),
        C.round_color(F.col("_color")).alias("color"), C.color_name(F.col("_color")).alias("color_name"))


def preserved_bookmarks(rows: DataFrame) -> DataFrame:
    return item_bookmarks(rows, "source_text")


def color_workflow_totals(exported: DataFrame, existing: DataFrame, tolerance: float = 5.0,
                          by: tuple[str, ...] | None = None) -> DataFrame:
    """Exported rows, rows whose colour changed, and rows found again among the annotations."""
    matched = match_positions(exported, existing, tolerance)
    return matched.groupBy(*(document_key(matched) if by is None else by)).agg(
        F.count("*").alias("exported"), F.count_if("recolored").alias("colors_standardized"),
        F.count("match_idx").alias("imported"))
