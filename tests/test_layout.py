import random

import pytest
from pyspark.sql import functions as F

from annolake.operators import layout as L
from annolake.operators.matching import match_positions

SCHEMA = ("study_id string, doc_id string, page int, annot_idx long, type string, content string, da string, "
          "rect struct<x0:double,y0:double,x1:double,y1:double>")


def boxes(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def box(i, x, y, page=1, kind="FreeText", text="AE.AETERM", w=60.0, h=12.0, doc="D", da="/Helv 10 Tf"):
    return ("S", doc, page, i, kind, text, da, (float(x), float(y), float(x + w), float(y + h)))


def running_mean(points, tolerance):
    groups, group = [], []
    for v in sorted(points):
        if group and abs(v - sum(group) / len(group)) <= tolerance:
            group.append(v)
        else:
            groups.append(group)
            group = [v]
    return [g for g in [*groups, group] if len(g) > 1]


def first_fit(points, tolerance):
    groups = {}
    for v in points:
        founder = next((f for f in groups if abs(v - f) <= tolerance), v)
        groups.setdefault(founder, []).append(v)
    return [g for g in groups.values() if len(g) > 1]


def grouped(df, tolerance, method):
    rows = L.proximity_groups(df.withColumn("at", F.col("rect.y0")), "at", tolerance, method).collect()
    out = {}
    for r in rows:
        out.setdefault((r["page"], r["group_id"]), (r["group_size"], pytest.approx(r["group_mean"])))
    return sorted(((k[0], *v) for k, v in out.items()), key=lambda t: (t[0], t[2].expected))


def test_worked_example(spark):
    df = boxes(spark, [box(i, 10 * i, y) for i, y in enumerate([100.5, 101.2, 99.8, 140, 145, 300])])
    assert grouped(df, 10.0, "running_mean") == [(1, 3, pytest.approx(100.5)), (1, 2, pytest.approx(142.5))]
    moved = L.align(df, vertical=False).filter("h_moved").select("rect.y0").collect()
    assert sorted(r[0] for r in moved) == [99.8, 101.2, 140, 145]


@pytest.mark.parametrize("method, brute", [("running_mean", running_mean), ("first_fit", first_fit)])
def test_groups_against_brute_force(spark, method, brute):
    rng = random.Random(5)
    pages = {p: [rng.choice([rng.randrange(0, 400) / 4, 50.0]) for _ in range(n)] for p, n in ((1, 80), (2, 30), (3, 1), (4, 400))}
    rows, i = [], 0
    for p, points in pages.items():
        for y in points:
            rows.append(box(i, 5, y, p))
            i += 1
    want = sorted((p, len(g), sum(g) / len(g)) for p, points in pages.items() for g in brute(points, 3.0))
    for parts in (1, 5):
        got = grouped(boxes(spark, rows, parts), 3.0, method)
        assert [g[:2] for g in sorted(got, key=lambda t: (t[0], t[1], t[2].expected))] == [w[:2] for w in want]
        assert sorted(g[2].expected for g in got) == pytest.approx(sorted(w[2] for w in want))


def test_groups_with_null_keys_and_chains(spark, monkeypatch):
    """Parts of the key may be null; dense chains, gaps of just the tolerance, negative coordinates."""
    rng = random.Random(9)
    for tolerance, large in ((0.0, 20), (0.1, 20), (1.0, 20), (7.5, 20), (1.0, 10_000)):
        monkeypatch.setattr(L, "LARGE_PAGE", large)  # pages are cut into sessions, or are not
        for method, brute in (("running_mean", running_mean), ("first_fit", first_fit)):
            points = [rng.choice([k * max(tolerance, 1.0) - 20, rng.randrange(-300, 300) / 10, 50.0]) for k in range(150)]
            rows = [(None, None, 1, i, "FreeText", "", "", (5.0, float(y), 6.0, float(y) + 1)) for i, y in enumerate(points)]
            got = grouped(boxes(spark, rows), tolerance, method)
            want = sorted((1, len(g), sum(g) / len(g)) for g in brute(points, tolerance))
            assert sorted(g[1] for g in got) == sorted(w[1] for w in want)
            assert sorted(g[2].expected for g in got) == pytest.approx(sorted(w[2] for w in want))


def test_grouping_plan(spark, monkeypatch):
    """The running mean needs no Python, and a page with gaps goes to many tasks."""
    monkeypatch.setattr(L, "LARGE_PAGE", 1000)
    rows = [box(i, 5, 40.0 * (i % 500) + i % 3) for i in range(6000)] + [box(i, 5, 40.0 * i, 2) for i in range(100)]
    df = boxes(spark, rows).withColumn("at", F.col("rect.y0"))
    points = df.groupBy(F.struct(*L.PAGE).alias("_page"), F.col("at").alias("_at")).agg(F.count("*").alias("_n"), F.min("annot_idx").alias("_first"))
    sessions = L._sessions(points, 10.0)
    assert sessions.select("_page", "_session").distinct().count() == 501
    dealt = sessions.repartition(8, "_page", "_session").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 400
    plan = L.proximity_groups(df, "at", 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_align_both_directions_and_operations(spark):
    df = boxes(spark, [box(0, 100, 50), box(1, 104, 52, text="x" * 40), box(2, 300, 51.9), box(3, 400, 400, kind="Square")])
    out = L.align(df)
    rows = {r["annot_idx"]: r for r in out.collect()}
    mean = (50 + 52 + 51.9) / 3
    assert tuple(rows[0]["aligned"]) == pytest.approx((102, mean, 162, mean + 12))
    assert not rows[3]["h_moved"] and tuple(rows[3]["aligned"]) == (400, 400, 460, 412)
    ops = L.alignment_operations(out).orderBy("alignment_type", "annot_idx").collect()
    assert [(o["alignment_type"], o["annot_idx"]) for o in ops] == [("horizontal", 0), ("horizontal", 1), ("horizontal", 2), ("vertical", 0), ("vertical", 1)]
    assert ops[1]["content_preview"] == "x" * 30 + "..."
    total = L.alignment_totals(out).collect()[0]
    assert (total["horizontal_groups"], total["vertical_groups"], total["horizontal_aligned"], total["vertical_aligned"]) == (1, 1, 3, 2)
    line = L.alignment_report(L.alignment_operations(out)).orderBy("alignment_type", "annot_idx").collect()[3]["line"]
    assert line.startswith("Page 1 [Group ") and line.endswith("aligned vertically (100.0, 51.3) -> (102.0, 51.3)")


def report(df):
    return [r["line"] for r in df.orderBy(*L.REPORT_ORDER).collect()]


def test_reports(spark):
    df = boxes(spark, [box(0, 100, 50), box(1, 104, 52), box(2, 300, 500, 2, w=20.0, text="a long text that needs room")])
    bar = "=" * 80
    assert report(L.alignment_report_lines(L.align(df))) == [
        bar, "ANNOTATION ALIGNMENT REPORT", bar, "",
        "Summary: Total annotations: 3, Horizontal groups: 1, Vertical groups: 1, Horizontal aligned: 2, Vertical aligned: 2, Errors: 0",
        "", "Alignment Operations:", "-" * 80, "", "Page 1:", "  Horizontal alignments: 2",
        "    Page 1 [Group 0]: 'AE.AETERM' aligned horizontally (100.0, 50.0) -> (100.0, 51.0)",
        "    Page 1 [Group 0]: 'AE.AETERM' aligned horizontally (104.0, 52.0) -> (104.0, 51.0)",
        "  Vertical alignments: 2",
        "    Page 1 [Group 0]: 'AE.AETERM' aligned vertically (100.0, 51.0) -> (102.0, 51.0)",
        "    Page 1 [Group 0]: 'AE.AETERM' aligned vertically (104.0, 51.0) -> (102.0, 51.0)", "", bar]
    still = report(L.alignment_report_lines(L.align(df, skip=[1])))
    assert still[5:] == ["", bar]
    lines = report(L.resize_report_lines(L.resize(df, "standard")))
    assert "Summary: Total annotations: 3, FreeText: 3, Checked: 3, Resized: 3, Skipped: 0, Errors: 0" in lines
    assert lines[-3].startswith("Page 2: 'a long text that needs room' [helv 10.0pt] (20.0x12.0) -> (")


def test_skipped_pages_stay(spark):
    df = boxes(spark, [box(0, 10, 50), box(1, 10, 55), box(2, 10, 50, 2), box(3, 10, 55, 2)])
    assert {r["page"] for r in L.align(df, skip=[2]).filter("h_moved").collect()} == {1}
    rows = spark.createDataFrame([("D", 1)], "doc_id string, page int")
    assert {r["page"] for r in L.align(df, skip=rows).filter("h_moved").collect()} == {2}
    lists = spark.createDataFrame([("1, 5, x, 999", 10)], "skip_pages string, page_count int")
    got = [(r["entry"], r["skip_page"], r["valid"]) for r in L.parse_skip_pages(lists).collect()]
    assert got == [("1", 1, True), ("5", 5, True), ("x", None, False), ("999", None, False)]


def test_resize_variants(spark):
    df = boxes(spark, [box(0, 0, 0, w=200.0, h=30.0), box(1, 0, 0, w=20.0, h=30.0, text="a long text that needs room"), box(2, 0, 0, text=" "),
                       box(3, 0, 0, kind="Square"), box(4, 0, 0, w=20.0, h=30.0, text="word " * 200)])
    rows = {v: {r["annot_idx"]: r for r in L.resize(df, v).collect()} for v in ("box", "standard", "export")}
    size = lambda r: (r["resized"]["x1"] - r["resized"]["x0"], r["resized"]["y1"] - r["resized"]["y0"])
    # the text fits: only the export variant widens
    assert not rows["box"][0]["changed"] and not rows["standard"][0]["changed"] and size(rows["export"][0]) == (205, 30)
    # the box variant may shrink a side, the standard one never does
    assert size(rows["box"][1])[1] == 16 and size(rows["standard"][1])[1] == 30
    assert size(rows["box"][4])[0] == 220 and size(rows["standard"][4])[0] == 220
    assert [rows[v][2]["checked"] for v in ("box", "standard", "export")] == [True, False, False]
    assert not any(rows[v][3]["checked"] for v in rows)
    height = {r["annot_idx"]: r for r in L.resize(df, "box", expand_width=False).collect()}
    assert size(height[1])[0] == 20 and height[1]["changed"]
    assert not L.resize(df, "box", expand_width=False, expand_height=False).filter("changed").count()
    total = L.resize_totals(L.resize(df, "box")).collect()[0]
    assert (total["total_annotations"], total["freetext_annotations"], total["checked"], total["resized"], total["skipped"]) == (5, 4, 4, 2, 2)
    with pytest.raises(ValueError):
        L.resize(df, "other")


def test_match_positions_against_all_pairs(spark):
    rng = random.Random(3)
    held = [box(i, rng.randrange(0, 30), rng.randrange(0, 30), text=rng.choice("ab"), w=rng.randrange(5, 12)) for i in range(60)]
    new = [box(100 + i, rng.randrange(-3, 33), rng.randrange(-3, 33), text=rng.choice("AB"), w=rng.randrange(5, 12)) for i in range(60)]
    got = {r["annot_idx"]: r["match_idx"] for r in match_positions(boxes(spark, new), boxes(spark, held)).collect()}
    for n in new:
        hits = [h[3] for h in held if h[5].upper() == n[5].upper() and all(abs(a - b) < 5 for a, b in zip(h[7], n[7]))]
        assert got[n[3]] == min(hits, default=None)


def test_documents_of_two_studies_stay_apart(spark):
    """One document name in two studies: totals, matches, headers, runs and file lines."""
    from annolake.operators import forms, matching
    from annolake.sources import xfdf
    rows = [(s, "crf", 1, i, "FreeText", text, (0.0, y, 10.0, y + 5)) for s, y in (("S1", 10.0), ("S2", 300.0))
            for i, text in enumerate((f"DM = {s} Label", "DMTERM"))]
    schema = ("study_id string, doc_id string, page int, annot_idx long, type string, content string, "
              "rect struct<x0:double,y0:double,x1:double,y1:double>")
    df = spark.createDataFrame(rows, schema)
    totals = L.alignment_totals(L.align(df)).collect()
    assert {r.study_id: r.horizontal_groups for r in totals} == {"S1": 1, "S2": 1}
    assert matching.match_positions(df.filter("study_id = 'S1'"), df.filter("study_id = 'S2'")).filter("match_idx is not null").count() == 0
    first = {r.study_id: r.label for r in forms.first_of_domain(forms.headers(df)).collect()}
    assert first == {"S1": "S1 Label", "S2": "S2 Label"}
    pages = spark.createDataFrame([("S1", "crf", 1, "A"), ("S1", "crf", 2, "A"), ("S2", "crf", 1, "A"), ("S2", "crf", 2, "B")],
                                  "study_id string, doc_id string, page int, form string")
    assert sorted(map(tuple, forms.form_runs(pages).collect())) == [("S1", "crf", 1, "A"), ("S2", "crf", 1, "A"), ("S2", "crf", 2, "B")]
    toc = forms.bookmarks(pages, forms.headers(df)).filter("level = 2 and section = 2").collect()
    assert {(r.study_id, r.domain) for r in toc} == {("S1", "DM"), ("S2", "DM")}
    assert "study_id" in xfdf.LINE_ORDER


def test_group_numbers_have_no_gaps(spark):
    boxes = spark.createDataFrame([("S", "d", 1, i, y) for i, y in enumerate((0.0, 100.0, 101.0, 200.0, 300.0, 301.0))],
                                  "study_id string, doc_id string, page int, annot_idx long, at double")
    got = L.proximity_groups(boxes, "at", 10.0).select("at", "group_id").collect()
    assert sorted(map(tuple, got)) == [(100.0, 0), (101.0, 0), (300.0, 1), (301.0, 1)]
