"""Registry and pattern catalogues over several studies, the batch folder job, state of the stream."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from annolake.operators import classify, patterns as P
from annolake.plans.check import check
from annolake.session import small_table
from annolake.sources.datasets import StudyRegistry
from annolake.streaming import folder_job
from annolake.streaming.check_stream import append_findings, stream_seen, unused_so_far
from annolake.workload import feeds as W

NOTES = ("study_id string, doc_id string, page int, annot_idx long, type string, author string, content string, "
         "rect struct<x0:double,y0:double,x1:double,y1:double>")


def notes(spark, rows):
    return spark.createDataFrame([(s, "D", 1, i, "FreeText", None, text, (1.0, 2.0, 3.0, 4.0)) for i, (s, text) in enumerate(rows)], NOTES)


def test_many_datasets_without_a_read_each(spark, tmp_path, monkeypatch):
    for study in range(20):
        os.makedirs(tmp_path / f"S{study}")
        for k in range(15):
            pq.write_table(pa.table({"STUDYID": ["x"], f"C{k}": [k], f"D{study}": [1.5]}), tmp_path / f"S{study}" / f"d{k:02d}.parquet")
    reads = []
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **_: reads.append(paths))
    registry = StudyRegistry(spark, str(tmp_path), labels={"D00": "First"})
    rows = registry.variable_catalog().collect()
    assert len(rows) == 900 and not reads
    got = {(r.study_id, r.domain, r.ordinal): (r.name, r.type) for r in rows}
    assert got["S3", "D07", 2] == ("C7", "numeric") and got["S19", "D14", 3] == ("D19", "numeric") and got["S0", "D00", 1] == ("STUDYID", "character")
    assert registry.dataset_catalog().filter("label = 'First'").count() == 20


def test_studies_with_one_dataset_name(spark, tmp_path):
    """A column, a QNAM and an IDVAR that one study has and the other lacks; CSV and part files."""
    for study, column, qnam in (("A", "AETERM", "Q1"), ("B", "AEDECOD", "Q2")):
        for kind in ("parquet", "csv"):
            folder = f"{tmp_path}/{kind}/{study}"
            for name, rows, schema in (("ae", [("1", "2")], f"STUDYID string, {column} string"), ("suppae", [(qnam, "v")], "QNAM string, QVAL string"),
                                       ("relrec", [(f"{qnam}SEQ", "x")], "IDVAR string, RELID string")):
                writer = spark.createDataFrame(rows * 3, schema).repartition(2).write
                (writer.option("header", True).csv if kind == "csv" else writer.parquet)(f"{folder}/{name}.{kind}")
    texts = [(s, t) for s in "AB" for t in ("AE.AETERM", "Q1 in SUPPAE")]
    for kind in ("parquet", "csv"):
        registry = StudyRegistry(spark, f"{tmp_path}/{kind}", kind)
        catalog = registry.catalog()
        assert catalog.study_keys == ("study_id",)
        assert sorted(map(tuple, registry.supp_values().collect())) == [("A", "SUPPAE", "Q1"), ("B", "SUPPAE", "Q2")]
        assert sorted(map(tuple, registry.relrec_values().collect())) == [("A", "Q1SEQ"), ("B", "Q2SEQ")]
        found = {(r.study_id, r.variable_name) for r in check(notes(spark, texts), catalog).findings.filter("rule_no in (6, 8)").collect()}
        assert found == {("B", "AETERM"), ("B", "Q1")}


def test_pattern_tables(spark):
    """Least ordinal wins within a study; entries without a valid regex and groups that are not there are left out."""
    rows = [("A", 2, "LATE", "d", r"(?P<v>[A-Z]+)\Z", {"variable_name": 1}, False), ("A", 1, "FIRST", "d", r"([A-Z]{2})\.(\w+)", {"domain": 1, "variable_name": 2}, False),
            ("B", 1, "BROKEN", "d", "(", {"value": 1}, False), ("B", 2, "NOTE", "d", r"\[(.+)\]", {"value": 1, "label": 7}, True)]
    table = small_table(spark, rows, f"study_id string, {P.CATALOG_SCHEMA}")
    df = notes(spark, [("A", "AE.AETERM"), ("A", "aeterm"), ("B", "[x $1 y]"), ("B", "AE.AETERM"), ("C", "AE.AETERM")])
    got = {(r.study_id, r.text): (r.pattern_type, r.domain, r.variable_name, r.value, r.is_comment)
           for r in classify.parse(df, table, study_keys=("study_id",)).collect()}
    assert got == {("A", "AE.AETERM"): ("FIRST", "AE", "AETERM", None, False), ("A", "aeterm"): ("LATE", "AE", "aeterm", None, False),
                   ("B", "[x $1 y]"): ("NOTE", None, None, "x $1 y", True), ("B", "AE.AETERM"): (None, None, None, None, False),
                   ("C", "AE.AETERM"): (None, None, None, None, False)}
    # one table for all gives what the list gives
    texts = W.annotations(spark, "/root/testdata/sf0.001").limit(500)
    same = [classify.parse(texts, p).drop("rect", "fill", "stroke") for p in (None, P.catalog_table(spark))]
    assert same[0].exceptAll(same[1]).count() == same[1].exceptAll(same[0]).count() == 0


def document(folder, name, *texts, foot=True):
    rows = "".join(f'<freetext page="0" rect="1,2,3,4"><contents>{t}</contents></freetext>\n' for t in texts)
    (folder / f"{name}.xfdf").write_text(f'<?xml version="1.0"?>\n<xfdf xmlns="http://ns.adobe.com/xfdf/">\n<annots>\n{rows}</annots>\n' + ("</xfdf>\n" if foot else ""))


def test_folder_job_restarts(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    document(source, "a", "one", "two")
    document(source, "b")
    document(source, "c", "lost", foot=False)
    (source / "d.xfdf").write_text("no document")
    run = lambda: folder_job.work_off(spark, str(source), target, f"{target}/state", files_per_batch=2).awaitTermination()
    told = lambda: {os.path.basename(r.file): (r.status, r.elements) for r in folder_job.ledger(spark, target).collect()}
    run()
    assert told() == {"a.xfdf": ("good", 2), "b.xfdf": ("empty", 0), "c.xfdf": ("bad", 0), "d.xfdf": ("bad", 0)}
    before = sorted(glob.glob(f"{target}/*/batch=*/*"))
    run()  # nothing new: nothing is written
    assert sorted(glob.glob(f"{target}/*/batch=*/*")) == before
    # a crash after the annotations of a batch are written, before its ledger is
    document(source, "e", "three")
    real = folder_job.xfdf.rejected

    def fails(parsed):
        raise RuntimeError("lost")
    monkeypatch.setattr(folder_job.xfdf, "rejected", fails)
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(folder_job.xfdf, "rejected", real)
    run()
    assert told()["e.xfdf"] == ("good", 1) and len(told()) == 5
    rows = spark.read.parquet(f"{target}/{folder_job.ANNOTATIONS}")
    assert sorted(r.content for r in rows.collect()) == ["one", "three", "two"]


def test_seen_domains_over_batches(spark, tmp_path):
    catalog = W.catalog(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    texts = [("S", "DM.AGE"), ("S", "AE.AETERM"), ("T", "AE = Adverse Events"), ("T", "VS.VSORRES")]
    for i in (0, 2):  # two batches
        notes(spark, texts[i:i + 2]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(NOTES).parquet(source)
        append_findings(stream_seen(stream, catalog), out, f"{tmp_path}/state", once=True).awaitTermination()
    assert sorted(r.domain for r in spark.read.parquet(out).collect()) == ["AE", "DM", "VS"]
    left = {r.domain for r in unused_so_far(spark, out, catalog).collect()}
    assert left == {d for d, _ in W.DATASETS} - {"DM", "AE", "VS"}
    assert left == {r.domain for r in check(notes(spark, texts), catalog).unused.select(F.col("domain")).collect()}
