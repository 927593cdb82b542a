"""How often rows are computed, and the batch functions beside plain Python."""
import re

import pytest
from pyspark.sql import functions as F

from annolake.functions import metrics as M, text as X
from annolake.operators import matching, patterns, report
from annolake.session import _LISTING, LISTING_TASKS, few_listing_tasks
from annolake.sources import xfdf


def counted(df, column):
    """``df`` with a column whose computations are counted."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    @F.udf("string")
    def same(value):
        seen.add(1)
        return value

    return df.withColumn(column, same.asNondeterministic()(F.col(column))), seen


def test_lines_are_computed_once_when_files_are_written(spark, tmp_path):
    rows = [("S", f"D{d}", 0, i, 0, "<?xml ?>" if i == 0 else "</xfdf>") for d in range(6) for i in range(2)]
    lines = spark.createDataFrame(rows, "study_id string, doc_id string, page int, annot_idx long, line_no int, line string")
    lines, seen = counted(lines, "line")
    # the accumulator counts the writing of the files only; the list reads the files
    files = xfdf.write_files(lines, str(tmp_path / "out"))
    assert files.count() == 6 and seen.value == len(rows)
    assert xfdf.read_lines(spark, str(tmp_path / "out")).count() == len(rows)


def test_folders_are_listed_by_few_tasks_and_the_setting_comes_back(spark):
    before = spark.conf.get(_LISTING)
    with pytest.raises(KeyError), few_listing_tasks(spark):
        assert int(spark.conf.get(_LISTING)) <= LISTING_TASKS
        raise KeyError
    assert spark.conf.get(_LISTING) == before


def test_report_counts_findings_once(spark):
    rows = [("S", "D", 1, i, "DM", "AGE", "ERROR", "m") for i in range(5)]
    found = spark.createDataFrame(rows, "study_id string, doc_id string, page int, annot_idx long, domain string, variable_name string, severity string, message string")
    found, seen = counted(found, "severity")
    lines = report.report_lines(found, "html").collect()
    assert seen.value == 2 * len(rows)  # totals and blocks
    assert [r.line for r in lines if r.section == 0 and r.line_no == 0] == ["<!DOCTYPE html>"]
    assert sorted((r.line_no, r.line) for r in lines if r.section == 2) == [(0, "</table>"), (1, "</body>"), (2, "</html>")]


def test_color_report_computes_colours_three_times(spark):
    rows = [("D", 1 + i % 2, i, "Red", 1.0, f"t{i}") for i in range(6)]
    colored = spark.createDataFrame(rows, "doc_id string, page int, annot_idx long, color_name string, r double, content string")
    colored = colored.withColumn("color", F.struct("r", F.lit(0.0).alias("g"), F.lit(0.0).alias("b"))).drop("r")
    colored, seen = counted(colored, "color_name")
    lines = report.color_report_lines(colored).collect()
    assert seen.value <= 3 * len(rows)  # shades, places among rows that have all keys, texts
    assert sum(r.line.startswith("    - ") for r in lines) == len(rows)


def test_widths_of_odd_characters(spark, texts):
    font = M.FONTS[0]
    of = {c: w for w, chars in M.HELVETICA_BOLD.items() for c in chars}
    values = ["", "ab", "é", "ÿA", "\x00a", "Ā€x", "𝒳a", None, "ü" * 3]
    wanted = [None if v is None else sum(0 if c == "\x00" else of.get(c, 278) if ord(c) < 128 else
                                         font.by_code[ord(c)] if ord(c) < 256 else 278 for c in v) for v in values]
    assert texts(font.units(F.col("v")), values) == wanted


def test_wrapping_folds_no_rows_in_expressions(spark):
    df = spark.createDataFrame([("aa bb cc", 20.0), ("aa bb cc", None), ("aa bb cc", float("nan")), (" ", 5.0), (None, 5.0), ("\t", 5.0)], "t string, w double")
    measure = M.TextMeasurer()
    out = df.select(measure.wrapped_lines(F.col("t"), "hebi", 10, F.col("w")).alias("lines"),
                    measure.wrapped_size(F.col("t"), "hebi", 10, F.col("w")).alias("size"),
                    measure.wrapped_lines(F.col("t"), F.lit("nofont"), 10, F.col("w")).alias("unknown"))
    assert "aggregate(" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    assert [r.lines for r in rows] == [["aa", "bb", "cc"], ["aa", "bb", "cc"], ["aa bb cc"], [], [], []]
    assert [r["size"] and r["size"].lines for r in rows] == [3, 3, 1, 0, None, 0]
    assert rows[0].unknown == ["aa", "bb", "cc"]


def test_needed_literals_stand_in_every_match():
    found = {p.name: patterns.needed_literals(p.regex) for p in patterns.DEFAULT_PATTERNS}
    assert found["VARIABLE_WHEN"] == ["when"] and found["COMMENT"] == []
    assert patterns.needed_literals(r"(?:a|b)?c+(?:=d)*") == ["c"]
    for regex, text in ((r"^X KiSs=(a|b)$", "x Kiſs=A"), (r"^(?:V\d|N:)x$", "n:X")):
        assert re.match(regex, text, re.I) and all(piece in text.lower() for piece in patterns.needed_literals(regex))


def test_domain_by_every_way_and_order(spark, texts):
    codes = X.RED_DOMAINS + X.BLUE_DOMAINS
    values = ["DAE =", "xSUPPDMx", "lbcat", "DM AE = 1", "SUPPSUPPAE", "FACAT", "zDA", "AEDM =", "", None, "VSCAT CMCAT", "CMAECAT"]

    def plain(v):
        t = v.upper()
        return next((d for d in codes if f"{d} =" in t or f"{d}CAT" in t or f"SUPP{d}" in t or t.startswith(d)), None)
    out = texts(X.domain_from_text(F.col("v")), values)
    assert out == [None if v is None else plain(v) for v in values]


def test_a_box_is_looked_for_in_four_cells_at_most(spark):
    rect = "named_struct('x0', {0}, 'y0', {1}, 'x1', {0} + 9, 'y1', {1} + 9)"
    at = [(x, y) for x in (-20.0, -5.1, 0.0, 14.9, 15.0, 19.9, 20.0, 25.0) for y in (0.0, 17.0)]
    notes = spark.createDataFrame([("D", 1, i, "t", x, y) for i, (x, y) in enumerate(at)], "doc_id string, page int, annot_idx long, content string, x double, y double")
    boxes = notes.withColumn("rect", F.expr(rect.format("x", "y"))).drop("x", "y")
    shifted = notes.withColumn("rect", F.expr(rect.format("(x + 4.9)", "(y - 4.9)"))).drop("x", "y")
    out = matching.match_positions(shifted, boxes)
    found = {r.annot_idx: r.match_idx for r in out.collect()}
    edges = lambda x, y: (x, y, x + 9, y + 9)
    near = lambda p, q: all(abs(a - b) < 5 for a, b in zip(edges(p[0] + 4.9, p[1] - 4.9), edges(*q)))
    assert found == {i: min((j for j, q in enumerate(at) if near(p, q)), default=None) for i, p in enumerate(at)}
    assert "array(-1, 0, 1)" not in out._jdf.queryExecution().toString() and "sequence(" in out._jdf.queryExecution().toString()
