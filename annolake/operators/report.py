"""Findings to counts, rankings, tables and report text.

Aggregates combine on the map side first, so a category or domain that holds a
third of the findings costs no more than any other.  ``by`` adds grouping
columns (a study, a document) to every figure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from annolake.functions.text import escape_markup, position_text
from annolake.operators.rules import ORDER, Catalog
from annolake.schemas import SEVERITIES, document_key


def _seen(findings: DataFrame) -> Column:
    """Position of a finding in document order, to break ties by first appearance."""
    return F.struct(*(c for c in ORDER if c in findings.columns))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def _percent_text(part: Column, whole: Column) -> Column:
    return F.concat(F.replace(F.format_number(_percent(part, whole), 1), F.lit(","), F.lit("")),
                    F.lit("%"))


# --- counts ----------------------------------------------------------------

def severity_totals(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Count and share per severity, zero rows kept."""
    counts = findings.groupBy(*by).agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    rows = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(s).alias("severity"),
                              F.col(s).alias("count")) for i, s in enumerate(SEVERITIES)))
    return counts.select(*by, "total", F.explode(rows).alias("_r")).select(
        *by, "_r.ord", "_r.severity", "_r.count",
        _percent_text(F.col("_r.count"), F.col("total")).alias("percent"))


def key_metrics(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Issues, errors, warnings, infos, distinct domains and variables: one row."""
    return findings.groupBy(*by).agg(
        F.count("*").alias("total_issues"),
        *(F.count_if(F.col("severity") == s).alias(n) for s, n in
          zip(SEVERITIES, ("errors", "warnings", "infos"))),
        F.countDistinct("domain").alias("unique_domains"),
        F.countDistinct("variable_name").alias("unique_variables"))


def category_counts(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return findings.groupBy(*by, "category").agg(F.count("*").alias("count"))


def domain_counts(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return findings.filter("domain is not null").groupBy(*by, "domain").agg(
        F.count("*").alias("count"))


def category_severity_summary(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Count per category and severity with the share of all, rounded half to even."""
    counts = findings.groupBy(*by, "category", "severity").agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*by))
    return counts.withColumn("percentage", F.bround(F.col("count") / total * 100, 1))


def type_counts(annotations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return annotations.groupBy(*by, "type").agg(F.count("*").alias("count"))


def dataset_coverage(parsed: DataFrame, catalog: Catalog) -> DataFrame:
    """Per dataset: columns the annotations name, columns they leave out, share named."""
    keys = [*catalog.study_keys, "domain"]
    named = parsed.filter("variable_name is not null").select(
        *keys, F.col("variable_name").alias("name")).distinct().withColumn("named", F.lit(True))
    return (catalog.variables.select(*keys, "name").join(named, [*keys, "name"], "left")
            .groupBy(*keys).agg(F.count("*").alias("variables"),
                                F.count_if("named").alias("referenced"))
            .select(*keys, "variables", "referenced",
                    (F.col("variables") - F.col("referenced")).alias("unused"),
                    F.bround(F.col("referenced") / F.col("variables") * 100, 1).alias("percent")))


# --- rankings --------------------------------------------------------------

def top_values(findings: DataFrame, column: str, n: int = 5, by: tuple[str, ...] = (),
               errors_only: bool = False) -> DataFrame:
    """The ``n`` commonest values of a column, ties in order of first appearance.

    ``errors_only`` keeps values that have an error, still ranked by all findings.
    """
    # one pass: a finding counts for the total and for its value; only ranked rows are gathered
    marks = F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("value")),
                    F.struct(F.lit(False).alias("all"), F.col(column).cast("string").alias("value")))
    rows = findings.select(*by, "severity", _seen(findings).alias("_seen"), F.explode(marks).alias("_m")).filter(
        "_m.all or _m.value is not null")
    counts = rows.groupBy(*by, F.col("_m.all").alias("_all"), F.col("_m.value").alias("_value")).agg(
        F.count("*").alias("count"), F.min("_seen").alias("_first"),
        F.bool_or(F.col("severity") == "ERROR").alias("_error"))
    if errors_only:
        counts = counts.filter("_all or _error")
    # a per-key ranking over one row per value; Spark keeps n rows per task first
    best = Window.partitionBy(*by, "_all").orderBy(F.desc("count"), "_first")
    ranked = counts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    entry = F.struct("rank", F.col("_value").alias(column), "count")
    gathered = ranked.groupBy(*by).agg(
        F.max(F.when(F.col("_all"), F.col("count"))).alias("_total"),
        F.array_sort(F.collect_list(F.when(~F.col("_all"), entry))).alias("_ranked"))
    return gathered.select(*by, "_total", F.inline("_ranked")).select(
        *by, "rank", column, "count", _percent_text(F.col("count"), F.col("_total")).alias("percent"))


def summary(findings: DataFrame, by: tuple[str, ...] = (), top: int = 5, top_errors: int = 2) -> DataFrame:
    """All dashboard figures of a group in one row, from one pass over the findings.

    ``top`` categories and domains are listed, and ``top_errors`` of those with errors.

    Each finding counts for the total, its category, its domain and its
    variable; those counts combine on the map side, are ranked per kind, and
    only the few ranked rows are gathered.  Variables are merely counted, so
    they are dealt to buckets instead of one ranking.
    """
    kinds = [("total", F.lit("")), ("category", F.col("category")), ("domain", F.col("domain")),
             ("variable", F.col("variable_name"))]
    marks = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("label")) for k, v in kinds))
    rows = findings.select(*by, "severity", _seen(findings).alias("_seen"),
                           F.explode(marks).alias("_m")).filter("_m.label is not null")
    counts = rows.groupBy(*by, F.col("_m.kind").alias("kind"), F.col("_m.label").alias("label")).agg(
        F.count("*").alias("n"), F.min("_seen").alias("_first"),
        *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    variable, error = F.col("kind") == "variable", F.col("ERROR") > 0
    bucket = F.when(variable, F.pmod(F.hash("label"), F.lit(997))).otherwise(F.lit(0))
    counts = counts.withColumn("_bucket", bucket)
    best = Window.partitionBy(*by, "kind", "_bucket").orderBy(F.desc("n"), "_first")
    counts = counts.withColumn("rank", F.row_number().over(best)).withColumn(
        "error_rank", F.sum(error.cast("int")).over(
            best.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def total(column: str, name: str) -> Column:
        value = F.max(F.when(F.col("kind") == "total", F.col(column)))
        return F.coalesce(value, F.lit(0)).alias(name)

    def ranked(kind: str) -> Column:
        entry = F.struct("rank", "label", F.col("n").alias("count"))
        wanted = (F.col("kind") == kind) & (F.col("rank") <= top)
        return F.array_sort(F.collect_list(F.when(wanted, entry)))

    def with_errors(kind: str) -> Column:
        wanted = (F.col("kind") == kind) & error & (F.col("error_rank") <= top_errors)
        names = F.array_sort(F.collect_list(F.when(wanted, F.struct("error_rank", "label"))))
        return F.transform(names, lambda e: e["label"])

    return counts.groupBy(*by).agg(
        total("n", "total_issues"),
        *(total(s, n) for s, n in zip(SEVERITIES, ("errors", "warnings", "infos"))),
        F.count_if(F.col("kind") == "domain").alias("unique_domains"),
        F.count_if(variable).alias("unique_variables"),
        ranked("category").alias("top_categories"), ranked("domain").alias("top_domains"),
        with_errors("category").alias("error_categories"),
        with_errors("domain").alias("error_domains"))


def _sentence() -> Column:
    def part(names: str, before: str, after: str) -> Column:
        text = F.concat(F.lit(before), F.concat_ws(", ", names), F.lit(after))
        return F.when(F.size(names) > 0, text).otherwise(F.lit(""))

    return (F.when(F.col("errors") > 0, F.concat(
        F.lit("Found "), F.col("errors").cast("string"),
        F.lit(" critical errors requiring attention. "),
        part("error_categories", "Focus on fixing '", "' issues "),
        part("error_domains", "in the ", " domain(s).")))
        .when(F.col("warnings") > 0, F.concat(
            F.lit("No critical errors found. Review "), F.col("warnings").cast("string"),
            F.lit(" warnings for potential improvements.")))
        .otherwise(F.lit("No critical errors found. All validations passed successfully!")))


def dashboard_sentence(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One sentence: errors and where to start, or warnings, or all clear.

    With errors but no domain the sentence ends after the categories.
    """
    return summary(findings, by).select(*by, _sentence().alias("summary"))


# --- tables ----------------------------------------------------------------

def details_table(findings: DataFrame, run_ts: str) -> DataFrame:
    return findings.select(
        *_keys(findings), F.col("page").alias("Page"), F.col("text").alias("Original Annotation"),
        F.col("domain").alias("Domain"), F.col("variable_name").alias("Variable"),
        F.col("value").alias("Value"), F.col("category").alias("Category"),
        F.col("severity").alias("Severity"), F.col("message").alias("Message"),
        F.col("suggested_correction").alias("Suggested Correction"),
        F.lit(run_ts).alias("Timestamp"))


def overview_table(findings: DataFrame) -> DataFrame:
    return findings.select(
        *_keys(findings), F.col("page").alias("Page"), F.col("text").alias("Annotation Text"),
        F.col("domain").alias("Domain"), F.col("label").alias("Label"),
        F.col("variable_name").alias("Variable"), F.col("value").alias("Value"),
        F.col("severity").alias("Validation Status"),
        F.coalesce("pattern_type", F.lit("None")).alias("Pattern Type"))


def unmatched_table(findings: DataFrame, run_ts: str) -> DataFrame:
    """Texts no pattern matched."""
    rows = findings.filter((F.coalesce("text", F.lit("")) != "") & F.col("pattern_type").isNull())
    return rows.select(
        *_keys(findings), F.col("page").alias("Page"), F.col("text").alias("Annotation Text"),
        position_text(F.col("x0"), F.col("y0")).alias("Position"), F.lit(run_ts).alias("Timestamp"))


UNUSED_REASON = "May be using vendor/external data or oversight in annotation"


def unused_table(unused: DataFrame) -> DataFrame:
    return unused.select(*(c for c in unused.columns if c != "domain"),
                         F.col("domain").alias("Dataset"),
                         F.lit(UNUSED_REASON).alias("Possible Reason"))


def _keys(findings: DataFrame) -> list[str]:
    return [c for c in ("study_id", "doc_id", "annot_idx", "part_idx", "rule_no", "token_no")
            if c in findings.columns]


def dashboard_table(findings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All dashboard figures as rows: ``section, ord, label, value, percent``."""
    whole, none = F.col("total_issues"), F.lit(None).cast("string")

    def line(section: str, order: Column, label: Column, value: Column, percent: Column = none):
        return F.struct(F.lit(section).alias("section"), order.cast("int").alias("ord"),
                        label.alias("label"), value.cast("string").alias("value"),
                        percent.alias("percent"))

    metrics = (("Total Issues", "total_issues"), ("Errors", "errors"), ("Warnings", "warnings"),
               ("Info", "infos"), ("Unique Domains", "unique_domains"),
               ("Unique Variables", "unique_variables"))
    lines = [line("Key Metrics", F.lit(i), F.lit(label), F.col(c))
             for i, (label, c) in enumerate(metrics)]
    lines += [line("Distribution by Severity", F.lit(i), F.lit(s), F.col(c),
                   _percent_text(F.col(c), whole))
              for i, (s, c) in enumerate(zip(SEVERITIES, ("errors", "warnings", "infos")))]

    def ranking(section: str, column: str) -> Column:
        return F.transform(column, lambda e: line(section, e["rank"], e["label"], e["count"],
                                                  _percent_text(e["count"], whole)))

    rows = F.concat(F.array(*lines), ranking("Most Common Issues", "top_categories"),
                    ranking("Top Domains with Issues", "top_domains"),
                    F.array(line("Summary", F.lit(0), _sentence(), none)))
    return summary(findings, by).select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def full_report(findings: DataFrame, unused: DataFrame, run_ts: str,
                by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The five report tables."""
    return {
        "dashboard": dashboard_table(findings, by),
        "details": details_table(findings, run_ts),
        "overview": overview_table(findings),
        "unmatched": unmatched_table(findings, run_ts),
        "unused_datasets": unused_table(unused),
    }


# --- report text -----------------------------------------------------------

# The page frame.  Titles are the report's contract; the style is this library's own.
HTML_HEAD = (
    "<!DOCTYPE html>", "<html>", "<head>", '<meta charset="utf-8">', "<style>",
    "body { font: 15px/1.5 system-ui, sans-serif; max-width: 64rem; margin: 2rem auto; }",
    "table { border-spacing: 0; margin-bottom: 1.5rem; }", "td, th { padding: 0.3rem 0.8rem; text-align: start; }",
    "tr + tr > * { border-top: 1px solid silver; }",
    ".error { color: firebrick; }", ".warning { color: darkorange; }", ".info { color: steelblue; }",
    "</style>", "</head>", "<body>", "<h1>SDTM Validation Report</h1>", "<h2>Summary</h2>",
    "<table>")
LINE_ORDER = ("section", "seen", "line_no")


def report_lines(findings: DataFrame, output_format: str = "html") -> DataFrame:
    """Report text as lines to be sorted by ``LINE_ORDER``: totals, then one block per finding.

    The totals count severities by their own names, upper-case as in the findings.
    """
    html = output_format == "html"
    totals = findings.agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    counted = [("Total Annotations", "n", ""), ("Errors", "ERROR", "error"),
               ("Warnings", "WARNING", "warning"), ("Info", "INFO", "info")]
    if html:
        head = list(HTML_HEAD)
        summary = [F.concat(F.lit(f"<tr><th>{label}</th><td"
                                  + (f" class='{css}'" if css else "") + ">"),
                            F.col(c).cast("string"), F.lit("</td></tr>"))
                   for label, c, css in counted]
        middle = ["</table>", "<h2>Detailed Results</h2>", "<table>",
                  "<tr><th>Domain</th><th>Variable</th><th>Severity</th><th>Message</th></tr>"]
        foot = ["</table>", "</body>", "</html>"]
    else:
        head = ["SDTM Validation Report", "=" * 50, "", "Summary", "-" * 20]
        summary = [F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c, _ in counted]
        middle = ["", "Detailed Results", "-" * 20]
        foot = []
    seen = _seen(findings)
    frame = [*map(F.lit, head), *summary, *map(F.lit, middle)]
    return _lines(findings, totals, frame, foot, seen, html)


def _lines(findings: DataFrame, totals: DataFrame, frame: list[Column], foot: list[str],
           seen: Column, html: bool) -> DataFrame:
    domain = F.coalesce("domain", F.lit(""))
    variable = F.coalesce("variable_name", F.lit(""))
    if html:
        block = [F.lit("<tr>"),
                 F.concat(F.lit("<td>"), escape_markup(domain), F.lit("</td>")),
                 F.concat(F.lit("<td>"), escape_markup(variable), F.lit("</td>")),
                 F.concat(F.lit("<td class='"), F.lower("severity"), F.lit("'>"),
                          F.col("severity"), F.lit("</td>")),
                 F.concat(F.lit("<td>"), escape_markup(F.col("message")), F.lit("</td>")),
                 F.lit("</tr>")]
    else:
        block = [F.concat(F.lit("Domain: "), domain), F.concat(F.lit("Variable: "), variable),
                 F.concat(F.lit("Severity: "), F.col("severity")),
                 F.concat(F.lit("Message: "), F.col("message")), F.lit("")]
    body = findings.select(F.lit(1).alias("section"), seen.alias("seen"),
                           F.posexplode(F.array(*block)).alias("line_no", "line"))
    nothing = F.lit(None).cast(body.schema["seen"].dataType)
    # head and foot leave one row of totals together, so that the findings are counted once
    sides = [F.struct(F.lit(section).alias("section"), F.lit(i).alias("line_no"), line.alias("line"))
             for section, lines in ((0, frame), (2, [*map(F.lit, foot)])) for i, line in enumerate(lines)]
    out = totals.select(F.explode(F.array(*sides)).alias("_s"))
    return out.select("_s.section", nothing.alias("seen"), "_s.line_no", "_s.line").unionByName(body)


# --- colours ---------------------------------------------------------------

def color_usage(colored: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """Per page and colour name: the colour first seen, count and first position.

    ``colored`` has ``color`` (rounded) and ``color_name``; the texts themselves
    stay rows, see ``color_usage_items``.
    """
    keys = keys or (*document_key(colored), "page")
    return colored.groupBy(*keys, "color_name").agg(
        F.min_by("color", "annot_idx").alias("color"), F.count("*").alias("count"),
        F.min("annot_idx").alias("first_idx"))


def distinct_colors(colored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return colored.select(*by, "color", "color_name").distinct()


def color_usage_items(colored: DataFrame, content: str = "content",
                      keys: tuple[str, ...] | None = None,
                      preview: int | None = None) -> DataFrame:
    """Texts under their page and colour name; sort by page, first_idx, annot_idx.

    ``preview``: only so many characters of each text, for a short report.
    """
    keys = keys or (*document_key(colored), "page")
    text = F.col(content) if preview is None else F.substring(content, 1, preview)
    first = color_usage(colored, keys).select(*keys, "color_name", "first_idx",
                                              F.col("color").alias("named_color"))
    return colored.join(first, [*keys, "color_name"]).select(
        *keys, "first_idx", "color_name", "named_color", "annot_idx",
        text.alias("content"))


def color_class_totals(classed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Red, blue and other boxes; boxes without a readable colour count in the total only."""
    kind = F.col("color_class")
    return classed.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(kind == "RED").alias("red"),
        F.count_if(kind == "BLUE").alias("blue"),
        F.count_if(kind.isNotNull() & ~kind.isin("RED", "BLUE")).alias("other"))


def color_report_lines(colored: DataFrame, content: str = "content") -> DataFrame:
    """Colour report of each document as lines to be sorted by ``doc_id, section, page,
    first_idx, annot_idx, line_no``: distinct colours, then texts by page and colour."""
    key = document_key(colored)
    # all but the texts come from one table of shades; the filter names all columns, so that
    # its readers share one shuffle
    shades = colored.groupBy(*key, "page", "color_name", "color").agg(
        F.count("*").alias("_n"), F.min("annot_idx").alias("_first")).filter("_n > 0 or _first is not null")
    places = shades.groupBy(*key, "page", "color_name").agg(F.min("_first").alias("first_idx"))
    items = colored.select(*key, "page", "color_name", "annot_idx", F.col(content).alias("content")).join(
        places, [*key, "page", "color_name"])
    zero = F.lit(0).cast("long")

    def lines(df: DataFrame, section: int, page: Column, first: Column, idx: Column, *texts: Column):
        return df.select(*key, F.lit(section).alias("section"), page.cast("int").alias("page"),
                         first.cast("long").alias("first_idx"), idx.cast("long").alias("annot_idx"),
                         F.posexplode(F.array(*texts)).alias("line_no", "line"))

    distinct = distinct_colors(shades, tuple(key))
    count = distinct.select(*key, "color").distinct().groupBy(*key).agg(F.count("*").alias("n"))
    channel = [F.col(f"color.{c}").cast("string") for c in "rgb"]
    shade = F.concat(F.lit("  "), "color_name", F.lit(": RGB("), F.concat_ws(", ", *channel), F.lit(")"))
    # distinct colours of a document are listed in channel order
    order = _sort_code(F.col("color"))
    pages = places.select(*key, "page").distinct()
    bar, rule = F.lit("=" * 80), F.lit("-" * 80)
    return (
        lines(count, 0, zero, zero, zero, bar, F.lit("PDF ANNOTATION COLOR USAGE REPORT"), bar, F.lit(""),
              F.concat(F.lit("Total Unique Colors: "), F.col("n").cast("string")), F.lit(""),
              F.lit("Unique Colors Found:"), rule)
        .unionByName(lines(distinct, 1, zero, order, zero, shade))
        .unionByName(lines(count, 2, zero, zero, zero, F.lit(""), bar, F.lit("COLOR USAGE BY PAGE"), bar,
                           F.lit("")))
        .unionByName(lines(pages, 3, F.col("page"), F.lit(-2), F.lit(-2), F.lit(""),
                           F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(":")), rule))
        .unionByName(lines(places, 3, F.col("page"), F.col("first_idx"), F.lit(-1), F.lit(""),
                           F.concat(F.lit("  "), "color_name", F.lit(":"))))
        .unionByName(lines(items, 3, F.col("page"), F.col("first_idx"), F.col("annot_idx"),
                           F.concat(F.lit("    - "), "content"))))


def _sort_code(color: Column) -> Column:
    """Channels (three places, 0 to 9.999) as equally long text that sorts like the numbers."""
    return F.concat(*(F.lpad(F.round(color[c] * 1000).cast("int").cast("string"), 4, "0") for c in "rgb"))


# --- samples ---------------------------------------------------------------

def first_rows(df: DataFrame, n: int, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps ``n`` per group and task before it shuffles."""
    place = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n)
