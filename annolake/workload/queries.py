"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annolake.functions import color as C
from annolake.functions import metrics as M
from annolake.functions import text as X
from annolake.functions.geometry import flip, rect, rect_text
from annolake.operators import classify, forms, layout, matching, patterns, report, rules
from annolake.operators import settings as S
from annolake.operators.patterns import DEFAULT_PATTERNS
from annolake.plans import standardize as ST
from annolake.plans.check import check
from annolake.session import shared_folder
from annolake.sources import audit, fdf, tables, xfdf
from annolake.sources.datasets import StudyRegistry
from annolake.workload import feeds as W

QUERIES = {}
KEY = ["study_id", "doc_id", "page", "annot_idx"]
EXACT = rules.CheckOptions(fuzzy=False)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def col_round(c: str, digits: int = 3):
    return F.round(F.col(c), digits).alias(c.split(".")[-1])


# --- extraction ------------------------------------------------------------

@query
def extract_positions(spark, sf):
    return tables.position_table(tables.extract(W.annotations(spark, sf))).select(
        "doc_id", "annot_idx", "Page", "Text", col_round("X"), col_round("Y"))


@query
def extract_authors(spark, sf):
    out = tables.author_table(tables.extract_full(W.annotations(spark, sf)), True)
    return out.select("doc_id", "annot_idx", "Page", "Author", "Content", "Type",
                      *(col_round(c) for c in ("X1", "Y1", "X2", "Y2")))


# --- parsing ---------------------------------------------------------------

def _parsed(spark, sf, dialect="config"):
    return classify.parse(tables.extract(W.annotations(spark, sf)), dialect=dialect,
                          dm_variables=W.catalog(spark).dm_names())


PARSED = [*KEY, "part_idx", "text", "pattern_type", "is_comment", "domain", "variable_name",
          "value", "condition", "label", "test_cd_variable", "test_cd_value", "variable_name_end"]


@query
def parse_config(spark, sf):
    return classify.accepted(_parsed(spark, sf)).select(*PARSED)


@query
def parse_builtin(spark, sf):
    return classify.accepted(_parsed(spark, sf, "builtin")).select(*PARSED)


@query
def parse_rejected(spark, sf):
    return classify.rejected(_parsed(spark, sf)).select(
        *KEY, "part_idx", "pattern_type", "reject_reason")


@query
def parse_by_study(spark, sf):
    """Studies with catalogues of their own in one job; a study without one matches nothing."""
    notes = tables.extract(W.annotations(spark, sf))
    rows = classify.parse(notes, W.study_patterns(spark), dm_variables=W.COLUMNS["DM"], study_keys=("study_id",))
    return classify.accepted(rows).select(*PARSED)


@query
def catalog_problems(spark, sf):
    return patterns.catalog_problems(W.part_patterns(spark, sf), ("study_id",))


@query
def variable_ranges(spark, sf):
    """Names that a range such as ``AGE1``-``AGE4`` stands for."""
    rows = classify.accepted(_parsed(spark, sf)).filter("variable_name_end is not null")
    return rows.select(*KEY, "part_idx", F.posexplode(classify.expand_range(
        F.col("variable_name"), F.col("variable_name_end"))).alias("no", "name"))


@query
def pattern_groups(spark, sf):
    """One pattern tried on every text: did it match, and with which groups."""
    tried = classify.try_pattern(tables.extract(W.annotations(spark, sf)), DEFAULT_PATTERNS[0])
    groups = F.array_join(F.transform(F.array_sort(F.map_entries("groups")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return tried.select(*KEY, "matched", groups.alias("groups"))


@query
def findings_ignoring(spark, sf):
    """The check without some domains and variables."""
    options = rules.CheckOptions(fuzzy=False, ignore_domains=("ae", "LB"), ignore_variables=("STUDYID", "USUBJID", "AGE"))
    return _findings(spark, sf, options).groupBy("domain", "variable_name", "rule_no", "severity").agg(F.count("*").alias("n"))


@query
def pattern_trials(spark, sf):
    return classify.pattern_hit_counts(tables.extract(W.annotations(spark, sf)))


# --- findings --------------------------------------------------------------

def _findings(spark, sf, options=EXACT):
    return check(W.annotations(spark, sf), W.catalog(spark), options).findings


@query
def missing_variables(spark, sf):
    catalog = W.catalog(spark)
    parsed = classify.accepted(_parsed(spark, sf))
    return rules.missing_variables(parsed, catalog).groupBy("domain", "variable_name").agg(
        F.count("*").alias("annotations"), F.countDistinct("doc_id").alias("documents"))


@query
def findings(spark, sf):
    return _findings(spark, sf).select(
        *KEY, "part_idx", "rule_no", "token_no", "domain", "variable_name", "severity", "category",
        "message", "suggested_correction")


@query
def study_findings(spark, sf):
    """Studies with datasets of their own, checked in one job; two have none."""
    registry = StudyRegistry(spark, W.study_folder(spark, sf, _run_folder(spark, "studies")), labels=dict(W.DATASETS))
    return check(W.annotations(spark, sf), registry.catalog(), EXACT).findings.groupBy(
        "study_id", "rule_no", "domain", "message").agg(F.count("*").alias("n"))


@query
def study_variables(spark, sf):
    """The columns of all studies' datasets, from their files' footers."""
    registry = StudyRegistry(spark, W.study_folder(spark, sf, _run_folder(spark, "studies")))
    return registry.variable_catalog().select("study_id", "domain", "ordinal", "name", "type").join(
        registry.dataset_catalog().select("study_id", "domain"), ["study_id", "domain"])


@query
def findings_similar(spark, sf):
    return _findings(spark, sf, rules.CheckOptions()).select(
        *KEY, "part_idx", "rule_no", "token_no", "domain", "variable_name", "severity", "category",
        "message")


@query
def unused_datasets(spark, sf):
    return report.unused_table(check(W.annotations(spark, sf), W.catalog(spark)).unused)


@query
def variable_metadata(spark, sf):
    parsed = classify.accepted(_parsed(spark, sf))
    return rules.variable_metadata(parsed, W.catalog(spark)).groupBy(
        "domain", "variable_name", "variable_type", "variable_length", "variable_label").agg(
        F.count("*").alias("n"))


# --- text ------------------------------------------------------------------

@query
def clean_pages(spark, sf):
    pages = W.table(spark, sf, "pages")
    return pages.select("page_id", X.clean_text(F.col("html")).alias("text"),
                        X.clean_text(F.col("html"), "simple").alias("simple"))


@query
def clean_documents(spark, sf):
    docs = W.table(spark, sf, "documents")
    return docs.select("doc_id", X.clean_text(F.col("text")).alias("text"))


@query
def header_texts(spark, sf):
    rows = tables.extract(W.annotations(spark, sf))
    text = F.col("content")
    return rows.select(*KEY, X.is_header(text).alias("is_header"),
                       X.header_code(text).alias("code"), X.header_label(text).alias("label"),
                       X.header_font_size(text).alias("font_size"),
                       X.upper_non_header(text).alias("recased"))


@query
def normalized_quotes(spark, sf):
    rows = tables.extract(W.annotations(spark, sf))
    return rows.select(*KEY, X.normalize_quotes(F.col("content")).alias("content"))


@query
def document_quotes(spark, sf):
    docs = W.table(spark, sf, "documents")
    return docs.select("doc_id", X.normalize_quotes(F.col("text")).alias("text"))


@query
def text_domains(spark, sf):
    rows = tables.extract(W.annotations(spark, sf))
    domain = X.domain_from_text(F.col("content"))
    return rows.select(*KEY, domain.alias("domain"), X.domain_from_words(F.col("content")).alias("word_domain"),
                       C.domain_color(domain, X.RED_DOMAINS).alias("color"))


@query
def document_domains(spark, sf):
    docs = W.table(spark, sf, "documents")
    return docs.select("doc_id", X.domain_from_text(F.col("text")).alias("domain"),
                       X.domain_from_words(F.col("text")).alias("word_domain"))


@query
def condition_parts(spark, sf):
    rows = classify.accepted(_parsed(spark, sf)).filter("condition is not null")
    pair = X.condition_pair(F.col("condition"))
    return rows.select(*KEY, "part_idx", pair["left"].alias("left_side"), pair["right"].alias("right_side"),
                       F.posexplode(X.condition_tokens(F.col("condition"))).alias("token_no", "token"))


@query
def previews(spark, sf):
    docs = W.table(spark, sf, "documents")
    text = F.col("text")
    return docs.select("doc_id", X.preview(text, 30).alias("short"), X.preview(text, 50).alias("longer"),
                       X.preview(text, 37, 40).alias("child"), X.author_or_default(F.col("source")).alias("author"))


@query
def author_texts(spark, sf):
    rows = W.annotations(spark, sf)
    hexed = C.to_hex(F.col("stroke"))
    return rows.select(*KEY, X.author_or_default(F.col("author"), "Reviewer").alias("author"),
                       X.style_text(F.lit(10.0), hexed, italic=False).alias("style"),
                       X.position_text(F.round("rect.x0", 2), F.round("rect.y0", 2)).alias("position"))


@query
def document_forms(spark, sf):
    docs = W.table(spark, sf, "documents")
    return docs.select("doc_id", X.form_name(F.col("text"), F.col("doc_id")).alias("form"))


# --- colours ---------------------------------------------------------------

@query
def standard_colors(spark, sf):
    color = F.col("stroke")
    rows = W.annotations(spark, sf)
    for name in ("v1", "v2", "v3"):
        rows = rows.withColumn(name, C.standardize_color(color, name))
    return rows.select(*KEY, C.to_hex(color).alias("hex"), *(C.to_hex(F.col(n)).alias(n) for n in ("v1", "v2", "v3")),
                       C.rgb_text(color).alias("rgb"), C.color_name(color).alias("name"),
                       C.output_class(color).alias("output_class"), C.byte_class(F.col("v3")).alias("byte_class"),
                       (C.from_hex(C.to_hex(color)) == C.from_hex(F.ltrim(C.to_hex(color), F.lit("#")))).alias("same"))


@query
def text_colors(spark, sf):
    rows = W.annotations(spark, sf)
    da, stroke, look = F.col("da"), F.col("stroke"), F.col("appearance_text")
    policies = {"da": (da, stroke), "export": (da, None, look), "archived": (da, stroke, look), "preserve": (da, stroke)}
    picked = {n: C.text_color(*args, policy=n) for n, args in policies.items()}
    return rows.select(*KEY, *(C.to_hex(c).alias(f"{n}_color") for n, c in picked.items()))


@query
def parsed_colors(spark, sf):
    rows = W.annotations(spark, sf).withColumn("hex", C.to_hex(F.col("stroke")))
    triple = F.expr("concat_ws(' ', cast(stroke.r as decimal(6,4)), cast(stroke.g as decimal(6,4)), cast(stroke.b as decimal(6,4)))")
    listed = F.expr("concat('rgb(', cast(stroke.r * 255 as int), ', ', cast(stroke.g * 255 as int), ',', cast(stroke.b * 255 as int), ')')")
    texts = F.when(F.col("type") == "Square", triple).when(F.col("type") == "Highlight", F.lit("none")).otherwise(F.col("hex"))
    rows = rows.withColumn("fill_text", texts).withColumn("style_text", F.when(F.col("type") == "Square", listed).otherwise(texts))
    return rows.select(*KEY, C.to_hex(C.parse_fill(F.col("fill_text"))).alias("fill"),
                       C.to_hex(C.parse_style_color(F.col("style_text"))).alias("style"))


@query
def output_color_totals(spark, sf):
    rows = W.annotations(spark, sf).filter("type = 'FreeText'")
    rows = rows.withColumn("color_class", C.output_class(C.color_from_da(F.col("da"))))
    return report.color_class_totals(rows, ("study_id",))


@query
def color_usage(spark, sf):
    rows = ST.preserve_colors(W.annotations(spark, sf))
    usage = report.color_usage(rows)
    return usage.select("doc_id", "page", "color_name", C.to_hex(F.col("color")).alias("color"), "count", "first_idx")


@query
def color_usage_items(spark, sf):
    rows = ST.preserve_colors(W.annotations(spark, sf))
    return report.color_usage_items(rows, "source_text").select(
        "doc_id", "page", "first_idx", "color_name", "annot_idx", "content")


@query
def color_report(spark, sf):
    return report.color_report_lines(ST.preserve_colors(W.annotations(spark, sf)), "source_text").drop("study_id")


@query
def annotation_samples(spark, sf):
    rows = tables.extract(W.annotations(spark, sf))
    return report.first_rows(rows, 5, ("doc_id",), ("page", "annot_idx")).select(
        "doc_id", "place", "page", "annot_idx", "content")


@query
def distinct_colors(spark, sf):
    rows = ST.preserve_colors(W.annotations(spark, sf))
    return report.distinct_colors(rows).select("color_name", *(F.col(f"color.{c}").alias(c) for c in "rgb"))


# --- sizes -----------------------------------------------------------------

@query
def da_fonts(spark, sf):
    rows = W.annotations(spark, sf)
    own, table = M.font_from_da(F.col("da")), M.font_for_table(F.col("da"))
    return rows.groupBy(own["name"].alias("font"), own["size"].alias("size"),
                        table["name"].alias("table_font"), table["size"].alias("table_size")).agg(F.count("*").alias("n"))


@query
def style_table(spark, sf):
    out = tables.style_table(W.annotations(spark, sf))
    places = [c for c in out.columns if c.startswith("Position_") or c in ("Width", "Height")]
    return out.select(*(c for c in out.columns if c not in places and c != "Content"), *(col_round(c) for c in places),
                      X.clean_text(F.col("Content")).alias("Content"))


@query
def text_boxes(spark, sf):
    measure = M.TextMeasurer()
    rows = tables.extract_full(W.annotations(spark, sf))
    text, limit = F.col("content"), F.col("rect.x1") - F.col("rect.x0")
    rows = rows.withColumn("line", measure.width(text, "hebi", 10))
    rows = rows.withColumn("plain", measure.dimensions(text, "hebi", 10, line=F.col("line")))
    rows = rows.withColumn("limited", measure.dimensions(text, "hebi", 10, limit, F.col("line")))
    rows = rows.withColumn("wrapped", measure.optimal(text, "hebi", 10, limit))
    rows = rows.withColumn("lines", measure.wrapped_lines(text, "hebi", 10, limit - 8))
    height = F.col("rect.y1") - F.col("rect.y0")
    return rows.select(*KEY, col_round("line"), F.round("plain.width", 3).alias("plain_width"),
                       F.round("plain.height", 3).alias("plain_height"), F.round("limited.width", 3).alias("limited_width"),
                       F.round("limited.height", 3).alias("limited_height"), F.round("wrapped.width", 3).alias("wrapped_width"),
                       F.round("wrapped.height", 3).alias("wrapped_height"), F.concat_ws("|", "lines").alias("lines"),
                       measure.fits(text, "hebi", 10, limit, height, F.col("line")).alias("fits"),
                       F.round(measure.width(text, "helv", 8), 3).alias("helvetica"), F.round(measure.width(text, "cour", 8), 3).alias("courier"))


@query
def document_widths(spark, sf):
    measure = M.TextMeasurer()
    docs = W.table(spark, sf, "documents")
    return docs.select("doc_id", F.round(measure.width(F.col("text"), "hebi", 10), 2).alias("width"))


# --- reports ---------------------------------------------------------------

@query
def severity_totals(spark, sf):
    return report.severity_totals(_findings(spark, sf))


@query
def study_severity_totals(spark, sf):
    return report.severity_totals(_findings(spark, sf), ("study_id",))


@query
def key_metrics(spark, sf):
    return report.key_metrics(_findings(spark, sf), ("study_id",))


@query
def category_counts(spark, sf):
    return report.category_counts(_findings(spark, sf))


@query
def domain_counts(spark, sf):
    return report.domain_counts(_findings(spark, sf), ("study_id",))


@query
def category_severity_summary(spark, sf):
    return report.category_severity_summary(_findings(spark, sf))


@query
def annotation_types(spark, sf):
    return report.type_counts(W.annotations(spark, sf), ("doc_id",))


@query
def dataset_coverage(spark, sf):
    return report.dataset_coverage(classify.accepted(_parsed(spark, sf)), W.catalog(spark))


@query
def top_categories(spark, sf):
    return report.top_values(_findings(spark, sf), "category")


@query
def top_domains(spark, sf):
    return report.top_values(_findings(spark, sf), "domain", 5, ("study_id",))


@query
def top_error_domains(spark, sf):
    return report.top_values(_findings(spark, sf), "domain", 2, ("doc_id",), errors_only=True)


@query
def dashboard(spark, sf):
    return report.dashboard_table(_findings(spark, sf))


@query
def report_details(spark, sf):
    return report.details_table(_findings(spark, sf), "2024-01-01 00:00:00")


@query
def report_overview(spark, sf):
    return report.overview_table(_findings(spark, sf))


@query
def report_unmatched(spark, sf):
    rows = _findings(spark, sf).withColumn("x0", F.round("x0", 2)).withColumn("y0", F.round("y0", 2))
    return report.unmatched_table(rows, "2024-01-01 00:00:00")


@query
def report_text(spark, sf):
    lines = report.report_lines(_findings(spark, sf), "text")
    return lines.groupBy("section", "line_no", "line").agg(F.count("*").alias("n"))


@query
def report_html(spark, sf):
    lines = report.report_lines(_findings(spark, sf), "html")
    return lines.groupBy("section", "line_no", "line").agg(F.count("*").alias("n"))


# --- catalogue look-ups ----------------------------------------------------

@query
def supplemental_names(spark, sf):
    """Part types as names, checked against the types of the largest parts per brand.

    The list must lack some names, or nothing would be missing."""
    part = W.table(spark, sf, "part")
    names = part.select(F.col("p_brand").alias("brand"), F.upper("p_type").alias("name"), "p_partkey")
    known = part.filter("p_size >= 48").select(
        F.col("p_brand").alias("brand"), F.upper("p_type").alias("name")).distinct().withColumn("known", F.lit(True))
    rows = rules.lookup(names, known, [(F.col("brand"), "brand"), (F.col("name"), "name")], {"known": "hit"},
                        salt=4, spread=["p_partkey"])
    return rows.filter("hit is null").groupBy("brand", "name").agg(F.count("*").alias("missing"))


@query
def record_links(spark, sf):
    """Order priorities as condition tokens, checked against those of open orders by customer.

    Open orders stand for the declared links; tokens of closed ones may be missing."""
    orders = W.table(spark, sf, "orders")
    known = orders.filter("o_orderstatus = 'O'").select(
        "o_custkey", F.upper(F.substring_index("o_orderpriority", "-", -1)).alias("idvar")).distinct()
    tokens = orders.select("o_orderkey", "o_custkey", F.posexplode(
        X.condition_tokens(F.upper("o_orderpriority"))).alias("token_no", "idvar"))
    return tokens.join(known, ["o_custkey", "idvar"], "left_anti").groupBy("idvar").agg(F.count("*").alias("missing"))


@query
def label_compare(spark, sf):
    """Supplier names with noise against the names of the suppliers of their nation's first key."""
    supplier, nation = W.table(spark, sf, "supplier"), W.table(spark, sf, "nation")
    rows = supplier.select("s_suppkey", F.col("s_nationkey").alias("domain"), F.when(
        F.col("s_acctbal") > 5000, F.concat(F.lit(" nation_"), F.col("s_nationkey").cast("string"), F.lit("  "))
    ).otherwise(F.col("s_name")).alias("label"))
    known = nation.select(F.col("n_nationkey").alias("domain"), F.col("n_name").alias("known"))
    joined = rules.lookup(rows, known, [(F.col("domain"), "domain")], {"known": "known"})
    same = F.lower(X.strip(F.col("label"))) == F.lower(X.strip(F.col("known")))
    return joined.select("s_suppkey", F.when(F.col("known").isNull(), "Wrong Domain").when(same, "ok")
                         .otherwise("Metadata Mismatch").alias("outcome"))


# --- layout ----------------------------------------------------------------

def _boxes(spark, sf):
    return W.event_boxes(spark, sf)


def _groups(spark, sf, at, tolerance, method):
    boxes = _boxes(spark, sf).withColumn("at", F.col(f"rect.{at}"))
    if method == "first_fit":
        boxes = boxes.filter("type = 'FreeText'")
    groups = layout.proximity_groups(boxes, "at", tolerance, method)
    return groups.select("doc_id", "page", "at", "group_id", "group_size", F.round("group_mean", 6).alias("group_mean"))


@query
def row_groups(spark, sf):
    return _groups(spark, sf, "y0", 10.0, "running_mean")


@query
def column_groups(spark, sf):
    return _groups(spark, sf, "x0", 10.0, "running_mean")


@query
def first_fit_groups(spark, sf):
    return _groups(spark, sf, "y0", 10.0, "first_fit")


def _corners(c: str):
    return [F.round(f"{c}.{k}", 4).alias(k) for k in ("x0", "y0", "x1", "y1")]


@query
def aligned_boxes(spark, sf):
    return layout.align(_boxes(spark, sf), numbered=False).select("doc_id", "annot_idx", "h_moved", "v_moved", *_corners("aligned"))


@query
def aligned_export_boxes(spark, sf):
    out = layout.align(_boxes(spark, sf), 1.0, 10.0, method="first_fit", skip=[2, 3], numbered=False)
    return out.select("doc_id", "annot_idx", "h_moved", "v_moved", *_corners("aligned"))


@query
def alignment_totals(spark, sf):
    return layout.alignment_totals(layout.align(_boxes(spark, sf), numbered=False), ("doc_id",))


@query
def alignment_report(spark, sf):
    return layout.alignment_report(layout.alignment_operations(layout.align(_boxes(spark, sf)))).select(
        "doc_id", "page", "alignment_type", "annot_idx", "line")


@query
def alignment_report_lines(spark, sf):
    """Whole alignment reports, head to foot."""
    lines = layout.alignment_report_lines(layout.align(_boxes(spark, sf)))
    return lines.select("doc_id", "section", "page", "part", "annot_idx", "line_no", "line")


def _resize(spark, sf, variant, **options):
    out = layout.resize(W.annotations(spark, sf), variant, **options)
    return out.select("doc_id", "annot_idx", "checked", "changed", *_corners("resized"))


@query
def resized_box_font(spark, sf):
    return _resize(spark, sf, "box")


@query
def resized_height_only(spark, sf):
    return _resize(spark, sf, "box", expand_width=False)


@query
def resized_standard(spark, sf):
    return _resize(spark, sf, "standard", skip=[7])


@query
def resized_export(spark, sf):
    return _resize(spark, sf, "export")


@query
def resize_totals(spark, sf):
    return layout.resize_totals(layout.resize(W.annotations(spark, sf), "box"), ("doc_id",))


@query
def resize_report(spark, sf):
    out = layout.resize(W.annotations(spark, sf), "standard")
    return layout.resize_report(layout.resize_operations(out)).select("doc_id", "annot_idx", "line")


@query
def skip_pages(spark, sf):
    lists = W.table(spark, sf, "events").select(
        "event_id", F.concat(F.col("user_id").cast("string"), F.lit(", 5, x,"), (F.col("event_id") % 90).cast("string"), F.lit(", ")
                             ).alias("skip_pages"), F.lit(60).alias("page_count"))
    return layout.parse_skip_pages(lists).select("event_id", "entry_no", "entry", "skip_page", "valid")


# --- forms and bookmarks ---------------------------------------------------

TOC = ["doc_id", "section", "domain", "sort_page", "ord", "level", "title", "page"]


@query
def form_runs(spark, sf):
    return forms.form_runs(forms.page_forms(W.event_pages(spark, sf)))


@query
def first_pages(spark, sf):
    return forms.first_of_domain(forms.headers(W.event_annotations(spark, sf)))


@query
def standard_bookmarks(spark, sf):
    return forms.bookmarks(forms.page_forms(W.event_pages(spark, sf)),
                           forms.headers(W.event_annotations(spark, sf))).select(*TOC)


@query
def script_bookmarks(spark, sf):
    return forms.script_bookmarks(W.event_pages(spark, sf), W.event_annotations(spark, sf)).select(*TOC)


@query
def xfdf_bookmarks(spark, sf):
    """Documents that have bookmarks already (one for each sign-up) and others."""
    pages, notes = W.event_pages(spark, sf), W.event_annotations(spark, sf)
    existing = W.table(spark, sf, "events").filter("event_type = 'signup'").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("doc_id"), F.col("event_id").alias("ord"),
        F.lit(1).alias("level"), F.when(F.col("value") > 30, F.lit("SDTM")).otherwise(F.lit("Contents")).alias("title"),
        F.lit(1).alias("page"))
    return forms.xfdf_bookmarks(forms.headers(notes), forms.page_forms(pages), existing).select(*TOC)


@query
def item_bookmarks(spark, sf):
    return forms.item_bookmarks(W.event_annotations(spark, sf)).select(*TOC)


@query
def preserved_bookmarks(spark, sf):
    return ST.preserved_bookmarks(ST.preserve_colors(W.annotations(spark, sf))).select(*TOC)


# --- standardize jobs ------------------------------------------------------

@query
def export_rows(spark, sf):
    out = ST.export(W.annotations(spark, sf), ST.StandardizeOptions(align=False))
    return out.select(*KEY, "author", "content", "font_size", "text_hex", "fill_hex", "resized", *_corners("xfdf_rect"))


@query
def export_aligned_rows(spark, sf):
    return ST.export(W.annotations(spark, sf)).select(*KEY, "content", "text_hex", "recolored", "resized",
                                                      *_corners("rect"))


@query
def export_lines(spark, sf):
    """Every line of every document, aligned and resized; coordinates to four places."""
    out = ST.export(W.annotations(spark, sf))
    box = F.col("xfdf_rect")
    out = out.withColumn("xfdf_rect", rect(*(F.round(box[c], 4) for c in ("x0", "y0", "x1", "y1"))))
    return xfdf.document_lines(out, "crf.pdf").select("doc_id", "page", "annot_idx", "line_no", "line")


@query
def library_rows(spark, sf):
    out = ST.standardize(W.annotations(spark, sf), ST.StandardizeOptions(align=False))
    style = F.col("style")
    return out.select(*KEY, "author", "is_header", "domain", "label", "checked", "resized",
                      style["font_size"].alias("font_size"), style["font_name"].alias("font_name"),
                      C.to_hex(style["text_color"]).alias("text"), C.to_hex(style["fill"]).alias("fill"),
                      C.to_hex(style["stroke"]).alias("stroke"), style["border_width"].alias("border_width"),
                      style["border_style"].alias("border_style"))


@query
def library_totals(spark, sf):
    out = ST.standardize(W.annotations(spark, sf))
    return ST.standardize_totals(out, by=("doc_id",))


@query
def preserved_rows(spark, sf):
    return ST.preserve_colors(W.annotations(spark, sf)).select(
        *KEY, "content", "is_header", "font_size", "color_name", C.to_hex(F.col("color")).alias("color"))


@query
def color_workflow(spark, sf):
    notes = W.annotations(spark, sf)
    out = ST.export(notes, ST.StandardizeOptions(align=False, auto_resize=False, quotes=False))
    return ST.color_workflow_totals(out, tables.extract_full(notes), by=("doc_id",))


@query
def position_matches(spark, sf):
    boxes = _boxes(spark, sf).select("doc_id", "page", "annot_idx", "content", "rect")
    shifted = boxes.withColumn("rect", F.expr(
        "named_struct('x0', rect.x0 + 3, 'y0', rect.y0 - 2, 'x1', rect.x1 + 3, 'y1', rect.y1 - 2)")).withColumn(
        "content", F.upper("content"))
    return matching.match_positions(shifted, boxes).select("doc_id", "page", "annot_idx", "match_idx")


# --- files -----------------------------------------------------------------

@query
def fdf_pages(spark, sf):
    events = W.table(spark, sf, "events")
    page = F.concat(F.lit("<</Page "), F.col("event_id").cast("string"), F.lit("/Type/Annot>>"))
    text = F.concat(F.lit("/Contents("), F.col("event_type"), F.lit(" of ("), F.col("value").cast("string"), F.lit("))/F 4"))
    lines = events.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("doc_id"), (F.col("event_id") / 700).cast("long").alias("block"),
        F.col("event_id").alias("pos"), F.when(F.col("event_type") == "click", page).when(F.col("event_type") == "view", text)
        .otherwise(F.lit("endobj")).alias("line"))
    return fdf.fdf_contents(lines).select("doc_id", "pos", "page", "content")


def _elements(spark, sf):
    """Raw XFDF elements, one per order line, as the file scan would give them."""
    notes = W.annotations(spark, sf)
    rich = F.col("type") != "Highlight"
    hexed, whole = C.to_hex(F.col("stroke")), F.col("type") == "Square"
    listed = F.concat(F.lit("rgb("), *[p for c in "rgb" for p in ((F.col(f"stroke.{c}") * 255).cast("int").cast("string"), F.lit(", "))][:-1], F.lit(")"))
    style = F.concat(F.lit("font-size:9.5pt;color:"), F.when(whole, listed).when(F.col("page") == 1, F.lit("blue")).otherwise(hexed), F.lit(";font-weight:bold"))
    return notes.select(
        "doc_id", "annot_idx", (F.col("page") - 1).cast("string").alias("page_text"),
        F.when(F.col("page") == 50, F.lit("1,2,3")).otherwise(rect_text(F.col("rect"))).alias("rect_text"),
        F.col("author").alias("title"), F.when(rich, hexed).alias("color"),
        F.when(~rich, F.col("content")).alias("contents"), F.when(rich, style).alias("body_style"),
        F.when(rich, F.col("content")).alias("paragraph"), F.lit(None).cast("string").alias("span_style"),
        F.lit(None).cast("string").alias("span"), F.col("da"), F.lit(None).cast("string").alias("corrupt"))


@query
def xfdf_elements(spark, sf):
    return xfdf.parse_elements(_elements(spark, sf)).select(
        "doc_id", "page", "annot_idx", "author", C.to_hex(F.col("fill")).alias("fill"), "content", "font_size",
        C.to_hex(F.col("text_color")).alias("text_color"), "error", *_corners("rect"))


@query
def xfdf_color_update(spark, sf):
    return xfdf.update_colors(_elements(spark, sf)).select("doc_id", "annot_idx", "new_style", "outcome")


@query
def xfdf_color_totals(spark, sf):
    return xfdf.color_update_totals(xfdf.update_colors(_elements(spark, sf)))


@query
def xfdf_restyled(spark, sf):
    return xfdf.restyle(_elements(spark, sf)).select(
        "doc_id", "annot_idx", "domain", "is_header", "new_text", "new_style", "new_color", "new_title")


@query
def xfdf_restyle_totals(spark, sf):
    return xfdf.restyle_totals(xfdf.restyle(_elements(spark, sf)))


def _file_elements(spark, sf):
    """Raw elements of documents of which five studies share a name; some cannot be used."""
    notes = W.annotations(spark, sf).filter("type = 'FreeText'")
    number = F.substring("doc_id", 5, 20).cast("long")
    page, color = F.col("page"), F.col("stroke")
    spanned = page == 45
    rich = spanned | F.startswith("da", F.lit("/Helv"))
    box = flip(F.col("rect"), F.lit(792.0))
    listed = F.concat(F.lit("color: rgb("), F.concat_ws(", ", *((color[c] * 255).cast("int").cast("string") for c in "rgb")), F.lit(")"))
    style = F.concat(F.lit("font-size:9.5pt;color:"), C.to_hex(color), F.lit(";font-weight:bold"))
    text = F.when(page != 47, F.col("content"))
    none = F.lit(None).cast("string")
    return notes.select(
        "study_id", F.concat(F.lit("CRF-"), F.floor(number / 5).cast("string")).alias("doc_id"), "annot_idx",
        F.when(page == 48, F.concat(F.lit("p"), page.cast("string"))).otherwise((page - 1).cast("string")).alias("page_text"),
        F.when(page == 50, F.lit("1,2,3")).when(page != 49, rect_text(rect(*(F.round(box[c], 4) for c in ("x0", "y0", "x1", "y1"))))).alias("rect_text"),
        F.col("author").alias("title"), F.when(rich, C.to_hex(color)).alias("color"), F.when(~rich, text).alias("contents"),
        F.when(rich & ~spanned, style).when(spanned, F.lit("font-size:9.5pt")).alias("body_style"),
        F.when(rich & ~spanned, text).alias("paragraph"), F.when(spanned, listed).alias("span_style"),
        F.when(spanned, text).alias("span"), none.alias("da"),
        F.when(page == 46, F.concat(F.lit('<freetext page="45" rect="1,2,3,4"><contents>A & B '), F.col("annot_idx").cast("string"), F.lit("</contents></freetext>"))).alias("corrupt"))


def _documents(spark, sf):
    """The folder of XFDF documents that these elements make."""
    folder = _run_folder(spark, "xfdf-in")
    elements = _file_elements(spark, sf)
    xfdf.write_elements(elements, folder, xfdf.element_texts(elements.columns), "crf.pdf", "gzip")
    return folder


@query
def xfdf_standardized(spark, sf):
    """Documents scanned, aligned, resized, written: every line of every file."""
    out = _run_folder(spark, "xfdf-out")
    ST.export_files(spark, _documents(spark, sf), out, pdf_name="crf.pdf", compression="gzip")
    return xfdf.read_lines(spark, out)


@query
def xfdf_rejected(spark, sf):
    """Why elements of those documents cannot be used."""
    found = xfdf.rejected(xfdf.parse_elements(xfdf.read_elements(spark, _documents(spark, sf))))
    return found.groupBy("study_id", "doc_id", "error").agg(F.count("*").alias("n"), F.count("corrupt").alias("texts"))


@query
def xfdf_findings(spark, sf):
    """The check of scanned documents."""
    notes = xfdf.annotations_of(xfdf.parse_elements(xfdf.read_elements(spark, _documents(spark, sf))))
    return check(notes, W.catalog(spark), EXACT).findings.groupBy("study_id", "doc_id", "rule_no", "message").agg(F.count("*").alias("n"))


@query
def xfdf_written_back(spark, sf):
    """Colours and styles updated, written as documents and scanned again."""
    out = {}
    for name, update in (("recolored", xfdf.update_colors), ("restyled", xfdf.restyle)):
        out[name] = _run_folder(spark, f"xfdf-{name}")
        elements = update(_file_elements(spark, sf).filter("corrupt is null"))
        xfdf.write_elements(elements, out[name], xfdf.element_texts(elements.columns), "crf.pdf", "gzip")
    both = [xfdf.read_elements(spark, folder).withColumn("job", F.lit(name)) for name, folder in out.items()]
    return both[0].unionByName(both[1]).groupBy("job", "study_id", "doc_id", "title", "color", "body_style", "paragraph", "contents", "span").agg(
        F.count("*").alias("n"))


@query
def xfdf_relinked(spark, sf):
    pages = W.table(spark, sf, "pages")
    files = pages.select(F.col("page_id").alias("doc_id"), F.concat(
        F.lit("<xfdf>\n<f  href='"), F.col("url"), F.lit("'/>\n"), F.col("html"), F.lit("</xfdf>")).alias("text"))
    linked = xfdf.relink(files, F.concat(F.lit("crf$"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    return xfdf.append_reference(linked.select("doc_id", F.col("new_text").alias("text"), "changed"), "out.pdf").select(
        "doc_id", "changed", "new_text")


# --- settings --------------------------------------------------------------

def _settings(spark, sf, version: int = 1):
    """One configuration per customer, settings drawn from its row."""
    c = W.table(spark, sf, "customer")
    number = F.col("c_custkey") * version
    entries = {
        "fuzzy_matching": (F.when(number % 7 == 0, "str").otherwise("bool"), F.when(number % 7 == 0, '"yes"').otherwise("true")),
        "fuzzy_threshold": (F.when(number % 5 == 0, "int").otherwise("float"),
                            F.when(number % 5 == 0, "1").when(number % 3 == 0, "1.5").otherwise("0.8")),
        "ignore_domains": (F.lit("list"), F.when(number % 4 == 0, '["ae", ""]').when(number % 4 == 1, '["ae"]').otherwise('["DM", 3]')),
        "ignore_variables": (F.lit("list"), F.when(number % 6 == 0, '["a b", "AGE_1", "x"]').otherwise('["STUDYID"]')),
        "output_format": (F.lit("str"), F.when(number % 8 == 0, '"pdf"').otherwise('"csv"')),
        "max_results": (F.when(number % 9 == 0, "bool").otherwise("int"), F.when(number % 9 == 0, "true").otherwise(
            (number * 11).cast("string"))),
    }
    rows = F.array(*(F.struct(F.lit(f"validation.{k}").alias("key"), kind.alias("kind"), value.alias("value"))
                     for k, (kind, value) in entries.items()))
    out = c.select(F.col("c_custkey").cast("string").alias("config_id"), F.explode(rows).alias("_s")).select("config_id", "_s.*")
    return out.unionByName(c.select(
        F.col("c_custkey").cast("string").alias("config_id"), F.lit("paths.output_directory").alias("key"),
        F.lit("str").alias("kind"), F.when(number % 2 == 0, '""').otherwise('"out/"').alias("value")))


@query
def settings_problems(spark, sf):
    return S.check_settings(_settings(spark, sf)).select("config_id", "key", "severity", "message")


@query
def configuration_problems(spark, sf):
    return S.check_configuration(_settings(spark, sf))


@query
def settings_changes(spark, sf):
    return S.settings_diff(_settings(spark, sf, 2), _settings(spark, sf))


@query
def settings_defaults(spark, sf):
    filled = S.with_defaults(_settings(spark, sf), {
        "validation.fuzzy_threshold": ("float", "0.85"), "validation.align_annotations": ("bool", "true")})
    return filled.select("config_id", "key", "kind", "value")


# --- audit -----------------------------------------------------------------

@query
def audit_filtered(spark, sf):
    return audit.filter_events(W.audit_events(spark, sf), "2024-01-02T00:00:00", "2024-01-20T23:59:59", status="success"
                               ).select("timestamp", "event_type", "user", "action", "details", "status")


@query
def audit_retained(spark, sf):
    kept = audit.retained(W.audit_events(spark, sf), "2024-01-10T00:00:00")
    return kept.groupBy(audit.event_date(F.col("timestamp")).alias("event_date"), "user").agg(F.count("*").alias("n"))


# --- streams ---------------------------------------------------------------

def _stream(spark, sf, name):
    """A given table as a stream of its files."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _run_folder(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def streamed_findings(spark, sf):
    from annolake.streaming.check_stream import append_findings, stream_findings

    folder = _run_folder(spark, "findings")
    rows = stream_findings(W.line_annotations(_stream(spark, sf, "lineitem")), W.catalog(spark), EXACT)
    append_findings(rows, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("study_id", "rule_no", "severity", "category").agg(F.count("*").alias("n"))


@query
def streamed_audit(spark, sf):
    from annolake.streaming.audit_stream import append_by_day, stream_events

    folder = _run_folder(spark, "audit")
    rows = stream_events(W.audit_rows(_stream(spark, sf, "events")), status="failure")
    append_by_day(rows, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy(F.col("event_date").cast("string").alias("event_date"), "user").agg(
        F.count("*").alias("n"))


@query
def streamed_unused(spark, sf):
    """Datasets that no batch of a stream names; the domains seen are its state."""
    from annolake.streaming.check_stream import append_findings, stream_seen, unused_so_far

    folder = _run_folder(spark, "seen")
    rows = stream_seen(W.line_annotations(_stream(spark, sf, "lineitem")), W.catalog(spark))
    append_findings(rows, f"{folder}/out", f"{folder}/state", once=True).awaitTermination()
    return unused_so_far(spark, f"{folder}/out", W.catalog(spark))


@query
def folder_totals(spark, sf):
    """A folder of documents worked off: good, empty and bad files, elements and rejects."""
    from annolake.streaming import folder_job

    source, target = _run_folder(spark, "folder-in"), _run_folder(spark, "folder-out")
    number = F.substring("doc_id", 5, 20).cast("long")
    elements, part = _file_elements(spark, sf).filter("corrupt is null"), F.col("_part")
    keep = ~((number % 3 == 1) & (part == 1)) & ~((number % 4 == 2) & (part == 2))
    xfdf.write_elements(elements, source, xfdf.element_texts(elements.columns), "crf.pdf", "gzip", listed=False, keep=keep)
    folder_job.work_off(spark, f"{source}/study_id=*/doc_id=*", target, f"{target}/state").awaitTermination()
    rejected = spark.read.parquet(f"{target}/{folder_job.REJECTED}")
    files = folder_job.ledger(spark, target).groupBy("status").agg(F.count("*").alias("files"), F.sum("elements").alias("elements"))
    return files.unionByName(rejected.groupBy(F.col("error").alias("status")).agg(F.countDistinct("doc_id").alias("files"), F.count("*").alias("elements")))
