import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from annolake.operators import classify, report, rules
from annolake.operators.similarity import closest, column_lists
from annolake.plans.check import check
from annolake.session import small_table

COLUMNS = {"DM": ["STUDYID", "USUBJID", "SUBJID", "AGE", "RFICDTC"], "AE": ["STUDYID", "USUBJID", "AESEQ", "AETERM"], "XX": ["XXA"],
           "SUPPDM": ["QNAM", "QVAL"], "SUPPAE": ["QVAL"], "RELREC": ["RDOMAIN", "IDVAR", "RELID"], "VS": ["VSORRES"], "PF": ["PFORRES"]}
LABELS = {"DM": "Demographics", "AE": "Adverse Events", "XX": None}


@pytest.fixture(scope="module")
def catalog(spark):
    return rules.Catalog(
        small_table(spark, [(d, LABELS.get(d, d), None) for d in COLUMNS], "domain string, label string, path string"),
        small_table(spark, [(d, i, n) for d, ns in COLUMNS.items() for i, n in enumerate(ns)], "domain string, ordinal int, name string"),
        small_table(spark, [("SUPPDM", "RACEOTH")], "domain string, qnam string"), small_table(spark, [("FASEQ",)], "idvar string"))


def notes(spark, values):
    return spark.createDataFrame([("S", "D", 1, i, v, (1.0, 2.0, 3.0, 4.0)) for i, v in enumerate(values)],
                                 "study_id string, doc_id string, page int, annot_idx long, content string, rect struct<x0:double,y0:double,x1:double,y1:double>")


def found(spark, catalog, text, **options):
    rows = check(notes(spark, [text]), catalog, rules.CheckOptions(**options)).findings.orderBy("part_idx", "rule_no", "token_no").collect()
    return [(r["severity"], r["category"], r["message"]) for r in rows]


GOLDEN = [
    ("no pattern here", [("INFO", "Pattern Match")]),
    ("AE = adverse events", []), ("ae = Adverse Events", []),
    ("AE = Adverse", [("ERROR", "Metadata Mismatch")]), ("XX = anything", [("WARNING", "Metadata Mismatch")]),
    ("ZZ = anything", [("ERROR", "Wrong Domain")]), ("ZZ.ZZTERM", []),
    ("AE.AETRM", [("WARNING", "Typo in Variable Name")]), ("AE.AEXXXXXX", [("ERROR", "Missing Variable")]),
    ("AE.STUDYID", []), ("RACEOTH in SUPPDM", []), ("OTHER in SUPPDM", [("ERROR", "Missing Variable")]),
    ("OTHER in SUPPAE", [("ERROR", "Missing Variable")]), ("OTHER in SUPPZZ", []),
    ("RELID in RELREC when FASEQ = AEGRPID", [("ERROR", "Missing Variable")]),
    ("PFORRES in PF when PFTESTCD = X", [("ERROR", "Incorrect Value")]), ("PFORRES in PF when PFTESTCD = CYTABNRM", []),
    ("NOTE: AE.AEXXXXXX", []),
]


def test_rules(spark, catalog):
    rows = check(notes(spark, [t for t, _ in GOLDEN]), catalog).findings.orderBy("annot_idx", "part_idx", "rule_no", "token_no").collect()
    for i, (text, want) in enumerate(GOLDEN):
        assert [(r["severity"], r["category"]) for r in rows if r["annot_idx"] == i] == want, text


def test_messages(spark, catalog):
    assert found(spark, catalog, "AE.AETRM")[0][2] == "Variable 'AETRM' not found in AE, but similar to 'AETERM' (similarity: 0.91)"
    assert found(spark, catalog, "AE.AETRM", fuzzy=False)[0][1] == "Missing Variable"
    assert found(spark, catalog, "AE.AETRM", threshold=0.95)[0][1] == "Missing Variable"
    assert found(spark, catalog, "RELID in RELREC when A = FASEQ and A")[1][2] == "Variable 'A' from condition not found in IDVAR of RELREC."
    assert found(spark, catalog, "OTHER in SUPPAE")[0][2] == "Domain SUPPAE is a SUPP domain but does not contain QNAM variable."


def test_options(spark, catalog):
    assert found(spark, catalog, "ae = wrong", ignore_domains=("Ae",)) == []
    assert found(spark, catalog, "AE.AEXXXXXX", ignore_variables=("AEXXXXXX",)) == []
    assert [f[1] for f in found(spark, catalog, "ZZ.ZZTERM", strict_domains=True)] == ["Wrong Domain"]
    for salt in (1, 4):
        assert [f[1] for f in found(spark, catalog, "AE.AETRM", salt=salt)] == ["Typo in Variable Name"]


def test_unused_datasets_use_the_domain_as_written(spark, catalog):
    result = check(notes(spark, ["AE.STUDYID", "VS.VSORRES"]), catalog)
    assert sorted(r["domain"] for r in result.unused.collect()) == ["DM", "PF", "RELREC", "SUPPAE", "SUPPDM", "XX"]


def test_own_rule(spark, catalog):
    def loud(rows, _):
        hit = rows.filter("variable_name = 'AGE'")
        return hit.select("study_id", "doc_id", "page", "annot_idx", "part_idx", F.lit(99).alias("rule_no"), F.lit(0).alias("token_no"),
                          F.lit("INFO").alias("severity"), F.lit("Own").alias("category"), F.lit("seen").alias("message"))
    rules.register_rule("loud", loud)
    try:
        assert found(spark, catalog, "DM.AGE") == [("INFO", "Own", "seen")]
    finally:
        rules.unregister_rule("loud")
    assert found(spark, catalog, "DM.AGE") == []


def test_several_studies(spark, catalog):
    def both(df, own):
        return df.withColumn("study_id", F.lit("S")).unionByName(own)
    extra = catalog.variables.filter("domain = 'AE'").withColumn("study_id", F.lit("T")).withColumn("name", F.lit("AEOTHER"))
    tables = rules.Catalog(
        catalog.datasets.withColumn("study_id", F.explode(F.array(F.lit("S"), F.lit("T")))), both(catalog.variables, extra),
        catalog.supp_values.withColumn("study_id", F.lit("S")), catalog.relrec_values.withColumn("study_id", F.lit("S")), ("study_id",))
    rows = notes(spark, ["AE.AETERM"]).withColumn("study_id", F.explode(F.array(F.lit("S"), F.lit("T"))))
    assert [(r["study_id"], r["category"]) for r in check(rows, tables).findings.collect()] == [("T", "Missing Variable")]


def test_dashboard_sentences(spark, catalog):
    one = lambda *t: report.dashboard_sentence(check(notes(spark, list(t)), catalog).findings).collect()[0][0]
    assert one("DM.AGE") == "No critical errors found. All validations passed successfully!"
    assert one("AE.AETRM") == "No critical errors found. Review 1 warnings for potential improvements."
    assert one("AE.AEXXXXXX", "AE.AEYYYYYY", "ZZ = a") == (
        "Found 3 critical errors requiring attention. Focus on fixing 'Missing Variable, Wrong Domain' issues in the AE, ZZ domain(s).")


def test_ranking_ties_keep_first_seen_order(spark, catalog):
    findings = check(notes(spark, ["ZZ = a", "OTHER in SUPPDM", "AE.AEXXXXXX"]), catalog).findings
    assert [r["domain"] for r in report.top_values(findings, "domain").orderBy("rank").collect()] == ["ZZ", "SUPPDM", "AE"]


def test_missing_variables(spark, catalog):
    parsed = classify.accepted(classify.parse(notes(spark, ["AE.AEXXXXXX", "ZZ.ZZX", "AE.AETERM"])))
    assert [r["variable_name"] for r in rules.missing_variables(parsed, catalog).collect()] == ["AEXXXXXX"]
    found = rules.variable_metadata(parsed, rules.Catalog(catalog.datasets, catalog.variables.select(
        "*", F.lit("character").alias("type"), F.lit(8).alias("length"), F.lit("L").alias("label"), F.lit("F").alias("format"), F.lit("I").alias("informat")),
        catalog.supp_values, catalog.relrec_values))
    assert {r["variable_name"]: r["variable_format"] for r in found.collect()} == {"AEXXXXXX": None, "ZZX": None, "AETERM": "F"}


def full_scan(word, names, threshold):
    best, ratio = None, 0
    for name in names:
        r = SequenceMatcher(None, word.lower(), name.lower()).ratio()
        if r > ratio:
            best, ratio = name, r
    return (best, ratio, f"{ratio:.2f}") if best and ratio >= threshold else None


def test_closest_equals_full_scan(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdAE1_") for _ in range(rng.randrange(1, 9)))
    rows = [(i, word(), [word() for _ in range(rng.randrange(0, 8))]) for i in range(400)]
    rows += [(1000, "tide", ["diet"]), (1001, "diet", ["tide"]), (1002, "AETRM", ["AESEQ", "AETERM", "AETERN"]), (1003, "xyz", [])]
    words = spark.createDataFrame([(str(i), w) for i, w, _ in rows], "domain string, word string")
    names = spark.createDataFrame([(str(i), k, n) for i, _, ns in rows for k, n in enumerate(ns)], "domain string, ordinal int, name string")
    lists = column_lists(names)
    for threshold in (0.1, 0.6, 0.85):
        got = words.join(lists, "domain", "left").select("domain", closest(F.col("word"), F.col("columns"), threshold).alias("c")).collect()
        assert {int(r.domain): r.c and tuple(r.c) for r in got} == {i: full_scan(w, ns, threshold) for i, w, ns in rows}
    plan = words.join(lists, "domain").select(closest(F.col("word"), F.col("columns")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
