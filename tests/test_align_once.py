"""Alignment: whole pages in one pass, large ones parted; rows are dealt out once."""
import random

import pytest
from pyspark.sql import functions as F

from annolake.operators import layout
from annolake.plans import standardize as ST
from annolake.schemas import ANNOTATIONS
from annolake.sources import xfdf


def boxes(spark):
    rng, rows = random.Random(7), []
    for study, doc, page, n in (("S", "D", 1, 60), ("S", "D", 2, 1), (None, "D", 1, 9), ("S", None, None, 12), ("T", "D", 1, 25), ("T", "E", 3, 2)):
        for i in range(n):
            x, y = (rng.choice((None, -0.0, 0.0, *(rng.randrange(400) / 4 for _ in range(9)))) for _ in range(2))
            rows.append((study, doc, page, rng.choice((i, i, i, None, 3)), rng.choice(("FreeText", "FreeText", "Square")), f"t{i}", x, y))
    df = spark.createDataFrame(rows, "study_id string, doc_id string, page int, annot_idx long, type string, content string, x double, y double")
    return df.select("study_id", "doc_id", "page", "annot_idx", "type", "content", F.struct(
        F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 9).alias("x1"), (F.col("y") + 9).alias("y1")).alias("rect"))


@pytest.mark.parametrize("method", ["running_mean", "first_fit"])
@pytest.mark.parametrize("only", [(True, True), (False, True)])
def test_small_and_large_pages_alike(spark, monkeypatch, method, only):
    def out():
        rows = layout.align(boxes(spark), 3.0, 7.0, *only, method, numbered=only[0], skip=[9])
        return sorted(map(repr, rows.collect()))
    small = out()
    monkeypatch.setattr(layout, "LARGE_PAGE", 5)
    assert out() == small and len(small) == 109


def test_pages_that_span_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = sorted(map(repr, layout.align(boxes(spark)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert sorted(map(repr, layout.align(boxes(spark)).collect())) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def final_plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def test_rows_meet_one_join_for_both_directions(spark):
    plan = final_plan(layout.align(boxes(spark), method="first_fit", numbered=False))
    assert plan.count("Join") == 1 and plan.count("MapInArrow") == 1


def annotations(spark):
    rows = [("S", f"D{i % 3}", 1 + i % 2, i, "FreeText", None, f"AE = Adverse {i}", (1.0 * i, 2.0, 50.0, 20.0), "/Helv 10 Tf 1 0 0 rg",
             "0 1 1 rg", None, None, 792.0) for i in range(20)]
    return spark.createDataFrame(rows, ANNOTATIONS)


def test_strings_of_colours_are_not_dealt_out(spark):
    rows = ST.export(annotations(spark)).select("annot_idx", "text_hex", "rect")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter"):]
    above = plan[:plan.index("Join LeftOuter")]
    assert "appearance_text" not in above and "source_color" in join
    got = {r.text_hex for r in rows.collect()}
    assert got == {"#FF0000"}


def test_library_deals_out_header_parts(spark):
    totals = ST.standardize_totals(ST.standardize(annotations(spark)))
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Join LeftOuter")]
    assert "regexp_extract(content" not in above and "domain" in above
    assert sorted((r.doc_id, r.headers_found, r.annotations_modified) for r in totals.collect()) == [("D0", 7, 7), ("D1", 7, 7), ("D2", 6, 6)]


def test_head_and_foot_from_one_reading(spark):
    lines = xfdf.document_lines(ST.export(annotations(spark), ST.StandardizeOptions(align=False)))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    first = [r.line for r in lines.filter("doc_id = 'D1'").orderBy("page", "annot_idx", "line_no").collect()]
    assert first[0].startswith("<?xml") and first[3:4] == ["  <annots>"] and first[-2:] == ["  </annots>", "</xfdf>"] and len(first) == 41
