"""Form runs and bookmark tables.

Bookmark rows carry sort columns (``section, domain, sort_page, ord``) instead
of one running number, so that no document has to pass through one task; the
sink sorts by ``toc_order(rows)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from annolake.functions.text import (domain_from_words, form_name, header_code, header_label,
                                     marked_form_name, preview, strip)
from annolake.schemas import document_key
from annolake.operators.ordered import carry_forward, page_chunk, with_previous

TOC_ORDER = ("study_id", "doc_id", "section", "domain", "level", "sort_page", "ord")
FORM_LABEL, DOMAIN_LABEL = "Form_bookmarks", "SDTM"
SCRIPT_HEADER = r"(?U)^[A-Z]{2}\s*=\s*[A-Z\s]+$"


def toc_order(toc: DataFrame) -> list[str]:
    """What bookmark rows are sorted by; tables of one study may lack the study."""
    return [c for c in TOC_ORDER if c in toc.columns]


def page_forms(pages: DataFrame, marked_only: bool = False) -> DataFrame:
    """``doc_id, page, form`` of each page; with ``marked_only`` only pages that say ``Form:``."""
    if marked_only:
        return pages.select(*document_key(pages), "page", marked_form_name(F.col("text")).alias("form")
                            ).filter("form is not null")
    return pages.select(*document_key(pages), "page", form_name(F.col("text"), F.col("page")).alias("form"))


def form_runs(page_forms: DataFrame) -> DataFrame:
    """First page of each run of equal form names; a name that returns starts a new run."""
    return _runs(page_forms).drop("opens")


def _runs(page_forms: DataFrame) -> DataFrame:
    """The same, and whether a run ``opens`` its document."""
    key = document_key(page_forms)
    rows = with_previous(page_forms, key, "page", "form", "_before", page_chunk(F.col("page")))
    return rows.filter("_before is null or _before <> form").select(
        *key, "page", "form", F.col("_before").isNull().alias("opens"))


def pages_with_run(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Every page with the first page of the run it stands in, null before the first run."""
    key = document_key(pages, runs)
    starts = runs.select(*key, "page", F.col("page").alias("_start"))
    rows = pages.select(*key, "page").join(starts, [*key, "page"], "left")
    return carry_forward(rows, key, "page", "_start", "run_page",
                         page_chunk(F.col("page"))).drop("_start")


def headers(annotations: DataFrame, content: str = "content", pattern: str | None = None) -> DataFrame:
    """Domain headers: document key, ``page, annot_idx, domain, label``."""
    args = () if pattern is None else (pattern,)
    return annotations.select(
        *document_key(annotations), "page", "annot_idx", header_code(F.col(content), *args).alias("domain"),
        header_label(F.col(content), *args).alias("label")).filter("domain is not null")


def script_headers(annotations: DataFrame, content: str = "content") -> DataFrame:
    """Headers as the stand-alone script reads them: labels in capitals only."""
    hit = strip(F.col(content)).rlike(SCRIPT_HEADER)
    return annotations.filter(hit).select(
        *document_key(annotations), "page", "annot_idx",
        strip(F.substring_index(F.col(content), "=", 1)).alias("domain"))


def first_of_domain(headers: DataFrame) -> DataFrame:
    """First page and first label of each domain of a document."""
    at = F.struct("page", "annot_idx")
    return headers.groupBy(*document_key(headers), "domain").agg(
        F.min("page").alias("first_page"), F.min_by("label", at).alias("label"))


def domain_runs(headers: DataFrame, pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Form runs under each domain they mention: document key, ``domain, run_page, form``."""
    key = document_key(headers, pages, runs)
    spots = headers.select(*key, "page", "domain").distinct()
    placed = spots.join(pages_with_run(pages, runs), [*key, "page"]).filter(
        "run_page is not null").select(*key, "domain", "run_page").distinct()
    return placed.join(runs.withColumnRenamed("page", "run_page"), [*key, "run_page"])


def _toc(df: DataFrame, section: int, level: int, title: Column, page: Column,
         domain: Column | None = None, sort_page: Column | None = None,
         order: Column | None = None) -> DataFrame:
    zero = F.lit(0)
    return df.select(
        *document_key(df), F.lit(section).alias("section"),
        (F.lit("") if domain is None else domain).alias("domain"),
        (zero if sort_page is None else sort_page).cast("int").alias("sort_page"),
        (zero if order is None else order).cast("long").alias("ord"),
        F.lit(level).alias("level"), title.alias("title"), page.cast("int").alias("page"))


def _headed(df: DataFrame, section: int, head: str, title: Column, page: Column,
            domain: Column | None = None, sort_page: Column | None = None) -> DataFrame:
    """Rows of level 2, and one of level 1 wherever ``opens`` is set; ``df`` is read once."""
    levels = F.when(F.col("opens"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    rows = df.withColumn("_level", F.explode(levels))
    below = F.col("_level") == 2
    zero = F.lit(0)
    return rows.select(
        *document_key(df), F.lit(section).alias("section"),
        F.when(below, F.lit("") if domain is None else domain).otherwise(F.lit("")).alias("domain"),
        F.when(below, zero if sort_page is None else sort_page).otherwise(zero).cast("int").alias("sort_page"),
        zero.cast("long").alias("ord"), F.col("_level").alias("level"),
        F.when(below, title).otherwise(F.lit(head)).alias("title"), F.when(below, page).otherwise(F.lit(1)).cast("int").alias("page"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bookmarks(page_forms: DataFrame, headers: DataFrame, form_label: str = FORM_LABEL,
              domain_label: str = DOMAIN_LABEL) -> DataFrame:
    """Two trees: forms in page order; domains by code with their forms below."""
    runs, first = _runs(page_forms), first_of_domain(headers)
    below = domain_runs(headers, page_forms, runs.drop("opens"))
    # the row that opens a document brings the tree's head along
    opens = F.col("domain") == F.min("domain").over(Window.partitionBy(*document_key(first)))
    return _union([
        _headed(runs, 1, form_label, F.col("form"), F.col("page"), sort_page=F.col("page")),
        _headed(first.withColumn("opens", opens), 2, domain_label, F.col("domain"), F.col("first_page"), F.col("domain")),
        _toc(below, 2, 3, F.col("form"), F.col("run_page"), F.col("domain"), F.col("run_page")),
    ])


def script_bookmarks(pages: DataFrame, annotations: DataFrame, content: str = "content") -> DataFrame:
    """As above from marked pages and capital headers; a domain points to its first form."""
    runs = form_runs(page_forms(pages, marked_only=True))
    below = domain_runs(script_headers(annotations, content), pages, runs)
    first = below.groupBy(*document_key(below), "domain").agg(F.min("run_page").alias("first_page"))
    documents = pages.select(*document_key(pages, annotations)).distinct()
    return _union([
        _toc(documents, 1, 1, F.lit(FORM_LABEL), F.lit(1)),
        _toc(runs, 1, 2, F.col("form"), F.col("page"), sort_page=F.col("page")),
        _toc(documents, 2, 1, F.lit(DOMAIN_LABEL), F.lit(1)),
        _toc(first, 2, 2, F.col("domain"), F.col("first_page"), F.col("domain")),
        _toc(below, 2, 3, F.col("form"), F.col("run_page"), F.col("domain"), F.col("run_page")),
    ])


def xfdf_bookmarks(headers: DataFrame, page_forms: DataFrame,
                   existing: DataFrame | None = None) -> DataFrame:
    """``DM - Demographics`` with one ``Page N - form`` per page.

    ``existing`` (``doc_id, ord, level, title, page``) keeps its entries not
    titled SDTM in front, in documents that have headers.
    """
    first = first_of_domain(headers)
    documents = first.select(*document_key(first)).distinct()
    key = document_key(headers, page_forms)
    spots = headers.select(*key, "domain", "page").distinct().join(page_forms, [*key, "page"])
    page = F.col("page")
    parts = [
        _toc(documents, 2, 1, F.lit(DOMAIN_LABEL), F.lit(1)),
        _toc(first, 2, 2, F.concat("domain", F.lit(" - "), "label"), F.col("first_page"),
             F.col("domain")),
        _toc(spots, 2, 3, F.concat(F.lit("Page "), page.cast("string"), F.lit(" - "), "form"), page,
             F.col("domain"), page),
    ]
    if existing is not None:
        kept = existing.filter(F.col("title") != DOMAIN_LABEL).join(
            documents, document_key(existing, documents), "left_semi")
        old = kept.select(*document_key(existing, documents), F.lit(0).alias("section"), F.lit("").alias("domain"),
                          F.lit(0).alias("sort_page"), F.col("ord").cast("long").alias("ord"),
                          F.col("level").cast("int").alias("level"), "title",
                          F.col("page").cast("int").alias("page"))
        parts.insert(0, old)
    return _union(parts)


def item_bookmarks(annotations: DataFrame, content: str = "content", children: int = 10) -> DataFrame:
    """Domains with up to ``children`` distinct texts below those that have a header."""
    key = document_key(annotations)
    rows = annotations.select(
        *key, "page", "annot_idx", header_code(F.col(content)).alias("_code"),
        header_label(F.col(content)).alias("label"), F.upper(content).alias("item"),
        domain_from_words(F.col(content)).alias("_word"))
    rows = rows.withColumn("domain", F.coalesce("_code", "_word")).filter("domain is not null")
    at = F.struct("page", "annot_idx")
    first = rows.groupBy(*key, "domain").agg(
        F.min("page").alias("first_page"),
        F.min_by("label", F.when(F.col("_code").isNotNull(), at)).alias("label"))
    texts = (rows.filter("_code is null").groupBy(*key, "domain", "item")
             .agg(F.min(at).alias("_at")))
    best = Window.partitionBy(*key, "domain").orderBy("_at")
    texts = texts.withColumn("_no", F.row_number().over(best)).filter(F.col("_no") <= children)
    texts = texts.join(first.filter("label is not null").select(*key, "domain"),
                       [*key, "domain"], "left_semi")
    title = F.when(F.col("label").isNotNull(), F.concat("domain", F.lit(" - "), "label")
                   ).otherwise(F.col("domain"))
    return _union([
        _toc(first.select(*document_key(first)).distinct(), 2, 1, F.lit(DOMAIN_LABEL), F.lit(1)),
        _toc(first, 2, 2, title, F.col("first_page"), F.col("domain")),
        _toc(texts, 2, 3, preview(F.col("item"), 37, 40), F.col("_at.page"), F.col("domain"),
             order=F.col("_no")),
    ])
