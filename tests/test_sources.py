import glob
import json

import pytest
from pyspark.sql import functions as F

from annolake.operators import settings as S
from annolake.plans import standardize as ST
from annolake.sources import audit, fdf, tables, xfdf
from annolake.sources.datasets import DatasetRegistry
from annolake.schemas import ANNOTATIONS
from annolake.workload import feeds as W

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def notes(spark):
    return W.annotations(spark, SF).persist()


def test_standardized_xfdf_round_trip(spark, notes, tmp_path):
    out = ST.export(notes.filter("doc_id = 'CRF-3'")).persist()
    xfdf.write_documents(xfdf.document_lines(out, "crf & co.pdf"), str(tmp_path / "x"))
    parts = sorted(glob.glob(f"{tmp_path}/x/study_id=*/doc_id=CRF-3/*.txt"))
    whole = "".join(open(p, encoding="utf8").read() for p in parts)
    assert whole.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<xfdf ') and whole.rstrip().endswith("</annots>\n</xfdf>")
    assert '<f href="crf &amp; co.pdf"/>' in whole
    (tmp_path / "one.xfdf").write_text(whole, encoding="utf8")
    back = xfdf.parse_elements(xfdf.read_elements(spark, str(tmp_path / "one.xfdf")))
    assert back.filter("error is not null").count() == 0
    pick = ("page", "content", "font_size")
    assert sorted(map(tuple, back.select(*pick).collect())) == sorted(map(tuple, out.select(*pick).collect()))
    assert back.select("rect").exceptAll(out.select(F.col("xfdf_rect").alias("rect"))).count() == 0
    order = [r["content"] for r in back.orderBy("annot_idx").collect()]
    assert order == [r["content"] for r in out.orderBy("page", "annot_idx").collect()]


def test_documents_in_and_out(spark, tmp_path):
    """Two studies with one document name, and one document of many lines: one whole file each."""
    text = "A & <B> \"quoted\""
    raw = [("S1", "d 1/x", i, str(i % 3), "1.5,2,30,40", "me", "#FF0000", None, "color:#112233;font-size:9pt", text, None, None, None, None) for i in range(4000)]
    raw += [("S2", "d 1/x", 0, "0", "1,2,3,4", None, None, text, None, None, None, None, "/F 9 Tf", None),
            ("S2", "other", 5, None, None, None, None, None, None, None, None, None, None, "<freetext page='1'><contents>a & b</contents></freetext>")]
    names = ("study_id doc_id annot_idx:long page_text rect_text title color contents body_style paragraph span_style span da corrupt").split()
    elements = spark.createDataFrame(raw, ", ".join(f"{n.split(':')[0]} {(n.split(':') + ['string'])[1]}" for n in names)).repartition(5)
    folder = str(tmp_path / "in")
    files = xfdf.write_files(xfdf.element_lines(elements, "a&b.pdf"), folder)
    assert sorted((r.study_id, r.doc_id) for r in files.collect()) == [("S1", "d 1/x"), ("S2", "d 1/x"), ("S2", "other")]
    assert len(glob.glob(f"{folder}/*/*/*.txt")) == 3
    back = xfdf.read_elements(spark, folder)
    cols = ["study_id", "doc_id", "page_text", "rect_text", "color", "paragraph", "contents", "da"]
    assert back.filter("corrupt is null").select(cols).exceptAll(elements.select(cols)).count() == 0
    parsed = xfdf.parse_elements(back)
    assert [(r.doc_id, r.error) for r in xfdf.rejected(parsed).collect()] == [("other", "broken element")]
    notes_ = xfdf.annotations_of(parsed, 100.0)
    assert notes_.schema.simpleString() == ANNOTATIONS.simpleString()
    one = notes_.filter("study_id = 'S1'").orderBy("annot_idx").first()
    assert (tuple(one.rect), one.content, one.da[:11]) == ((1.5, 60, 30, 98), text, "/Helv 9 Tf ")
    # files that the list does not name are not read
    with open(glob.glob(f"{folder}/study_id=S2/doc_id=other/*.txt")[0].replace("part-", "part-9"), "w") as f:
        f.write("half a line")
    assert xfdf.read_lines(spark, folder).filter("doc_id = 'other'").count() == 7
    rows, bad = ST.export_files(spark, folder, str(tmp_path / "out"), ST.StandardizeOptions(align=False))
    assert rows.count() == 2 and bad.count() == 2


def test_broken_elements_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.xfdf").write_text(
        '<xfdf xmlns="http://ns.adobe.com/xfdf/"><annots>'
        '<freetext page="0" rect="1,2,3,4" color="255 0 0"><contents>A &amp; B</contents></freetext>'
        '<freetext page="1" rect="1,2,3"><contents>x</contents></freetext><freetext page="1"><contents>x</contents></freetext>'
        '<freetext page="1" rect="1,2,3,4"></freetext><freetext page="z" rect="1,2,3,4"><contents>x</contents></freetext>'
        '<freetext page="2" rect="1,2,3,4"><contents-richtext><body style="font-size:12pt"><p><span style="color: rgb(255, 0, 0)">S</span></p></body></contents-richtext></freetext>'
        '</annots></xfdf>')
    rows = xfdf.parse_elements(xfdf.read_elements(spark, str(tmp_path))).orderBy("annot_idx").collect()
    assert [r["error"] for r in rows] == [None, "invalid rect format", "missing rect attribute", "missing content", "invalid page", None]
    assert (rows[0]["page"], rows[0]["content"], tuple(rows[0]["fill"])) == (1, "A & B", (1, 0, 0))
    assert (rows[5]["content"], rows[5]["font_size"], tuple(rows[5]["text_color"])) == ("S", 12, (1, 0, 0))


@pytest.mark.parametrize("writer, row, take", [("write_simple", "text", "extract"), ("write_fields", "field", "extract_full"), ("write_typed", "text", "extract_full")])
def test_element_sinks(spark, notes, tmp_path, writer, row, take):
    rows = getattr(tables, take)(notes.filter("doc_id in ('CRF-1', 'CRF-2')"))
    getattr(xfdf, writer)(rows, str(tmp_path / "out"))
    # two studies with one document name stay apart
    rows = rows.unionByName(rows.filter("doc_id = 'CRF-1'").withColumn("study_id", F.lit("ST9")))
    getattr(xfdf, writer)(rows, str(tmp_path / "two"))
    back = spark.read.format("xml").option("rowTag", row).load(f"{tmp_path}/two")
    per = lambda df: {(r.study_id, r.doc_id): r["count"] for r in df.groupBy("study_id", "doc_id").count().collect()}
    assert per(back) == per(rows) and len(per(back)) == 3


def test_relink(spark):
    files = spark.createDataFrame([("a", "<f href=\"x.pdf\"/>"), ("b", "<f  href='x.pdf'/>"), ("c", '<f href="n$1.pdf"/>'), ("d", "none")], "doc_id string, text string")
    rows = {r["doc_id"]: r for r in xfdf.relink(files, "n$1.pdf").collect()}
    assert [rows[k]["changed"] for k in "abcd"] == [True, True, False, False]
    assert rows["b"]["new_text"] == '<f href="n$1.pdf"/>'


def test_fdf_files(spark, tmp_path):
    (tmp_path / "a.fdf").write_bytes("/Contents(lost)/F\n<</Page 3/T>>\n/Contents(caf\xe9 (x))/F\nendobj\n/Page 4/ /Contents(two)/\n".encode("latin-1"))
    rows = fdf.fdf_contents(fdf.read_fdf_lines(spark, str(tmp_path))).orderBy("block", "pos").collect()
    assert [(r["page"], r["content"]) for r in rows] == [(3, "caf\xe9 (x)"), (4, "two")]


def test_dataset_registry(spark, tmp_path):
    spark.createDataFrame([("S", 2.0), ("T", 1.0)], "SUBJID string, AGE double").coalesce(1).write.parquet(f"{tmp_path}/dm.parquet")
    spark.createDataFrame([("RACEOTH",), ("RACEOTH",)], "QNAM string").write.parquet(f"{tmp_path}/suppdm.parquet")
    spark.createDataFrame([("AESEQ",)], "IDVAR string").write.parquet(f"{tmp_path}/relrec.parquet")
    reg = DatasetRegistry(spark, str(tmp_path), labels={"dm": "Demographics"})
    assert reg.domains() == ["DM", "RELREC", "SUPPDM"] and reg.variables_of("dm") == ["SUBJID", "AGE"]
    assert reg.has_variable("DM", "AGE") and not reg.has_variable("DM", "age") and reg.dataset("ZZ") is None
    assert reg.sample("DM", "SUBJID", 1, order="AGE") == ["T"] and reg.sample("DM", "X") == []
    assert [(r["name"], r["type"]) for r in reg.variable_catalog().filter("domain = 'DM'").orderBy("ordinal").collect()] == [("SUBJID", "character"), ("AGE", "numeric")]
    assert [tuple(r) for r in reg.supp_values().collect()] == [("SUPPDM", "RACEOTH")]
    assert [r[0] for r in reg.relrec_values().collect()] == ["AESEQ"]
    spark.createDataFrame([(1,)], "VSSEQ int").write.parquet(f"{tmp_path}/vs.parquet")
    assert "VS" not in reg.domains()
    reg.refresh()
    assert "VS" in reg.domains() and reg.catalog().datasets.count() == 4


def test_audit_log(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    event = {"timestamp": "2024-01-02T10:00:00", "event_type": "login", "user": "u1", "action": "a", "details": {"k": 1}, "status": "success", "ip_address": None}
    (logs / "audit_2024-01-02.json").write_text(json.dumps([event, {**event, "timestamp": "2024-01-03T09:00:00", "status": "failure"}]))
    (logs / "audit_2024-01-03.json").write_text("{not json")
    events = audit.read_audit_log(spark, str(logs))
    assert events.count() == 2 and json.loads(events.first()["details"]) == {"k": 1}
    for _ in range(2):
        audit.append_events(events, f"{tmp_path}/table")
    table = spark.read.parquet(f"{tmp_path}/table").withColumn("event_date", F.col("event_date").cast("string"))
    assert audit.filter_events(table, start="2024-01-03T00:00:00").count() == 2
    assert audit.filter_events(table, end="2024-01-02T10:00:00", event_type="login", user="u1", status="success").count() == 2
    assert audit.retained(table, None).count() == 0
    audit.retire_events(spark, f"{tmp_path}/table", f"{tmp_path}/kept", "2024-01-02T11:00:00")
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 2


def test_flat_exports(spark, notes, tmp_path):
    rows = tables.position_table(tables.extract(notes))
    for kind in ("parquet", "csv", "json"):
        tables.write_table(rows, f"{tmp_path}/{kind}", kind)
        assert getattr(spark.read, kind)(f"{tmp_path}/{kind}").count() >= rows.count()
    with pytest.raises(ValueError):
        tables.write_table(rows, f"{tmp_path}/x", "xlsx")
    assert len(tables.style_table(notes).drop("study_id", "doc_id", "annot_idx").columns) == 28


def test_findings_export(spark, notes, tmp_path):
    from annolake.operators.report import LINE_ORDER, report_lines
    from annolake.plans.check import check

    findings = check(notes.filter("page < 4"), W.catalog(spark)).findings.persist()
    tables.export_findings(findings, f"{tmp_path}/f", "2024-01-01 00:00:00")
    assert spark.read.csv(f"{tmp_path}/f_details", header=True).count() == findings.count()
    summary = spark.read.csv(f"{tmp_path}/f_summary", header=True)
    assert summary.columns == ["Category", "Severity", "Count", "Percentage"]
    xfdf.write_lines(report_lines(findings, "text"), f"{tmp_path}/report", LINE_ORDER)
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/report/*.txt")))
    assert text.startswith("SDTM Validation Report\n" + "=" * 50)
    assert f"Total Annotations: {findings.count()}\n" in text and text.count("Message: ") == findings.count()


def test_settings(spark):
    loaded = S.load_settings("annotation_patterns: {settings: {fuzzy_threshold: 0.8}}\nvalidation: {ignore_domains: [ZZ]}")
    assert loaded["annotation_patterns.settings"] == {"fuzzy_matching": True, "fuzzy_threshold": 0.85}
    assert loaded["validation"]["ignore_domains"] == ["ZZ"] and loaded["validation"]["vertical_tolerance"] == 10.0
    rows = S.settings_rows(spark, {
        "good": {"v": {"fuzzy_matching": True, "fuzzy_threshold": 0.5, "output_format": "csv", "include_timestamp": False, "max_results": 5, "ignore_domains": ["AE"]}},
        "bad": {"v": {"fuzzy_matching": 1, "fuzzy_threshold": -0.5, "ignore_domains": ["ae", "", 3], "ignore_variables": ["lower"], "output_format": "pdf", "max_results": 0}}})
    got = [(r["config_id"], r["severity"], r["message"]) for r in S.check_settings(rows).orderBy("config_id", "rule_no", "message_no").collect()]
    assert got == [("bad", "error", "Fuzzy Matching must be of type bool"), ("bad", "error", "Fuzzy Threshold must be greater than or equal to 0.0"),
                   ("bad", "warning", "Domain should be uppercase: ae"), ("bad", "error", "Domain cannot be empty"), ("bad", "error", "Domain must be a string, got int"),
                   ("bad", "error", "Output Format must be one of: xlsx, csv, json"), ("bad", "error", "Missing required setting: Include Timestamp"),
                   ("bad", "error", "Max Results must be greater than or equal to 1")]
    own = (S.SettingRule("max_results", "Max", "int", custom=lambda v: F.array(F.struct(F.lit("error").alias("severity"), F.concat(F.lit("odd "), v).alias("message")))),)
    assert [r["message"] for r in S.check_settings(rows.filter("config_id = 'good'"), own).collect()] == ["odd 5"]


def test_pattern_requirements(spark):
    table = spark.createDataFrame([(1, "A", "x", {"value": 1}), (2, "", "", None), (3, "C", None, {})],
                                  "ordinal int, name string, regex string, groups map<string,int>")
    assert [tuple(r) for r in S.check_patterns(table).collect()] == [
        (2, "Pattern name is required"), (2, "Pattern Unnamed is missing regex"), (2, "Pattern Unnamed is missing groups"),
        (3, "Pattern C is missing regex"), (3, "Pattern C is missing groups")]


def test_color_workflow_and_updates(spark, notes):
    totals = ST.color_workflow_totals(ST.export(notes, ST.StandardizeOptions(align=False, auto_resize=False, quotes=False)), tables.extract_full(notes), by=())
    row = totals.collect()[0]
    assert row["exported"] == row["imported"] == notes.filter("type = 'FreeText'").count()
    style = spark.createDataFrame([("background-color:#fff;color:#0033FF;x:y", "p"), ("color:blue;", "p"), ("color:#0000FF;", "p"), ("color:#0033FF", "p"), (None, None)], "body_style string, paragraph string")
    got = [(r["new_style"], r["outcome"]) for r in xfdf.update_colors(style).collect()]
    assert got[1:] == [("color:blue;", "unchanged"), ("color:#0000FF;", "unchanged"), ("color:#0033FF", None), (None, None)]
