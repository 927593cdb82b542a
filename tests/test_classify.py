import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from annolake.operators import classify as K
from annolake.operators import patterns as P

DM = ["STUDYID", "USUBJID", "SUBJID", "AGE", "RFICDTC"]

# text -> (pattern, [(domain, variable, other fields)]); no rows means rejected
GOLDEN = {
    "SV = Subject Visit": ("DOMAIN_LABEL", [("SV", None, {"label": "Subject Visit"})]),
    "sv = Subject Visit": ("DOMAIN_LABEL", [("sv", None, {"label": "Subject Visit"})]),
    "AE = 'x'": ("DOMAIN_LABEL", [("AE", None, {"label": "'x'"})]),
    "DM = A = B": ("VARIABLE_VALUE_GENERIC", [("DM", "DM", {"value": "A = B"})]),
    "DSCAT = 'PROTOCOL MILESTONE'": ("VARIABLE_VALUE_SINGLE_QUOTES", [("DS", "DSCAT", {"value": "PROTOCOL MILESTONE"})]),
    "DSCAT = 'X": ("VARIABLE_VALUE_SINGLE_QUOTES_GENERIC", [("DS", "DSCAT", {"value": "X"})]),
    "SUBJID = 123": ("VARIABLE_VALUE_GENERIC", [("DM", "SUBJID", {"value": "123"})]),
    "VAR = 'value' when COND = VALUE": ("VARIABLE_VALUE_CONDITION", [("VA", "VAR", {"value": "value", "condition": "COND = VALUE"})]),
    "RELREC when FASPID = AESPID": ("DOMAIN_WHEN_CONDITION", []),
    "PFORRES when PFTESTCD = CYTABNRM": ("DOMAIN_WHEN_CONDITION", []),
    "PFORRES1 when PFTESTCD = CYTABNRM": ("VARIABLE_WITH_TESTCD_CONDITION", [("PF", "PFORRES1", {"condition": "PFTESTCD = CYTABNRM", "test_cd_variable": "PFTESTCD"})]),
    "VSORRES1 when VSTESTCD HEIGHT": ("VARIABLE_WHEN", [("VS", "VSORRES1", {"condition": "VSTESTCD HEIGHT"})]),
    "VSORRES,VSORRESU when VSTESTCD=HEIGHT": ("VAR_LIST_WHEN", [("VS", "VSORRES", {"condition": "VSTESTCD=HEIGHT"}), ("VS", "VSORRESU", {"condition": "VSTESTCD=HEIGHT"})]),
    "FACAT,FAOBJ = 'value'": ("VAR_LIST_VALUE", [("FA", "FACAT", {"value": "'value'"}), ("FA", "FAOBJ", {"value": "'value'"})]),
    "DSSTDTC/RFICDTC": ("VAR_LIST_GENERIC", [("DS", "DSSTDTC", {}), ("DM", "RFICDTC", {})]),
    'DOMAIN=DM VARIABLE=SUBJID VALUE="1"': ("DOMAIN_EQUALS", [("DM", "SUBJID", {"value": "1"})]),
    'DM SUBJID = "123"': ("DOMAIN_VAR_VALUE", [("DM", "SUBJID", {"value": "123"})]),
    "DM.SUBJID": ("DOMAIN_VAR", [("DM", "SUBJID", {})]),
    "DM-SUBJID": ("DOMAIN_VAR_HYPHEN", [("DM", "SUBJID", {})]),
    "DM|SUBJID": ("DOMAIN_VAR_PIPE", [("DM", "SUBJID", {})]),
    "RACEOTH in SUPPDM": ("SUPP_DOMAIN", [("SUPPDM", "RACEOTH", {"condition": None})]),
    "RACEOTH in SUPPDM when X = 1": ("SUPP_DOMAIN", [("SUPPDM", "RACEOTH", {"condition": "X = 1"})]),
    "RELID in RELREC when FASEQ = AEGRPID": ("VARIABLE_IN_DOMAIN_WHEN", [("RELREC", "RELID", {"condition": "FASEQ = AEGRPID"})]),
    "VAR1-VAR4": ("VARIABLE_RANGE", [("VA", "VAR1", {"variable_name_end": "VAR4"})]),
    "QVAL1-QVAL3 in SUPPDM": ("VARIABLE_RANGE", [("SUPPDM", "QVAL1", {"variable_name_end": "QVAL3"})]),
    "SUBJID": ("SINGLE_VARIABLE", [("DM", "SUBJID", {})]),
    "subjid": ("SINGLE_VARIABLE", []), "dm.subjid": ("DOMAIN_VAR", []), "A": ("SINGLE_VARIABLE", []),
    "hello world": (None, [(None, None, {})]),
}
COMMENTS = {"NOT SUBMITTED": "NOT_SUBMITTED_COMMENT", "[NOT SUBMITTED]": "BRACKET_VALUE", "[VALUE]": "BRACKET_VALUE",
            "NOTE: check": "COMMENT", "Capture in DM?": "COMMENT", "V1.0": "COMMENT"}


def parse(spark, values, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "annot_idx long, content string")
    return K.parse(df, dm_variables=DM, **options)


def test_golden_texts(spark):
    rows = parse(spark, list(GOLDEN)).orderBy("annot_idx", "part_idx").collect()
    for text, (pattern, wanted) in GOLDEN.items():
        got = [r for r in rows if r["content"] == text]
        assert {r["pattern_type"] for r in got} == {pattern}, text
        kept = [r for r in got if r["reject_reason"] is None]
        assert [(r["domain"], r["variable_name"]) for r in kept] == [w[:2] for w in wanted], text
        for r, w in zip(kept, wanted):
            assert {k: r[k] for k in w[2]} == w[2], text


def test_comments(spark):
    rows = parse(spark, list(COMMENTS)).collect()
    assert {r["content"]: r["pattern_type"] for r in rows} == COMMENTS
    assert all(r["is_comment"] and r["reject_reason"] is None for r in rows)
    assert [p.name for p in P.DEFAULT_PATTERNS if p.is_comment] == ["NOT_SUBMITTED_COMMENT", "BRACKET_VALUE", "COMMENT"]


def test_builtin_dialect(spark):
    rows = parse(spark, ["RELREC when FASPID = AESPID", "RELREC when FASPID", "PFORRES when PFTESTCD = CYTABNRM"], dialect="builtin")
    got = [(r["domain"], r["variable_name"], r["value"], r["condition"]) for r in rows.orderBy("annot_idx", "part_idx").collect()]
    assert got == [("RELREC", "FASPID", "AESPID", None), ("RELREC", "AESPID", "FASPID", None),
                   ("RELREC", "IDVAR", None, "FASPID"), ("PF", "PFORRES", None, "PFTESTCD = CYTABNRM")]
    assert len(P.BUILTIN_PATTERNS) == 21


def test_builtin_dialect_takes_unlisted_names(spark):
    own = [P.Pattern("PAIR", "two groups", r"^(\w+)~(\w+)$"), P.Pattern("ONE", "one group", r"^~(\w+)$")]
    rows = parse(spark, ["AETERM~x", "~AETERM"], dialect="builtin", patterns=own).orderBy("annot_idx").collect()
    assert [(r["domain"], r["variable_name"], r["value"]) for r in rows] == [("AE", "AETERM", "x"), ("AE", "AETERM", None)]


def test_unanchored_pattern_matches_at_the_start(spark):
    own = [P.Pattern("P", "", r"AE|(?P<v>DM)x", {"value": 1, "domain": 9})]
    rows = parse(spark, ["AEx", "xAE", "DMx"], patterns=own).orderBy("annot_idx").collect()
    assert [r["pattern_type"] for r in rows] == ["P", None, "P"]


def test_study_specific_dm_lists(spark):
    df = spark.createDataFrame([("s1", "d", 1, 1, "LBX"), ("s2", "d", 1, 2, "LBX")], "study_id string, doc_id string, page int, annot_idx long, content string")
    names = spark.createDataFrame([("s2", "LBX")], "study_id string, name string")
    for salt in (1, 3):
        rows = K.parse(df, dm_variables=names, study_keys=("study_id",), salt=salt).orderBy("annot_idx").collect()
        assert [r["domain"] for r in rows] == ["LB", "DM"]


def test_pattern_trials_are_case_sensitive(spark):
    df = spark.createDataFrame([("DM.SUBJID",), ("dm.subjid",), ("DM-X1",)], "content string")
    counts = {r["pattern_type"]: r.asDict() for r in K.pattern_hit_counts(df).collect()}
    assert counts["DOMAIN_VAR"]["matched"] == 1
    assert (counts["VARIABLE_RANGE"]["matched"], counts["VARIABLE_RANGE"]["won"], counts["VARIABLE_RANGE"]["shared"]) == (1, 0, 1)
    one = K.try_pattern(df, P.Pattern("X", "", r"^(..)\.(.+)", {"domain": 1, "variable": 2, "none": 7})).collect()
    assert [r["matched"] for r in one] == [True, True, False]
    assert one[0]["groups"] == {"domain": "DM", "variable": "SUBJID", "none": None} and one[2]["groups"] is None


def test_expand_range(spark):
    df = spark.createDataFrame([("VAR1", "VAR3"), ("A1", "B3")], "a string, b string")
    assert [r[0] for r in df.select(K.expand_range(df["a"], df["b"])).collect()] == [["VAR1", "VAR2", "VAR3"], ["A1", "B3"]]


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["DM", "AE", "VAR1", " ", " ", "=", "'", '"', "when", "in", "SUPPDM", ",", "/", "-", ".", "|", "[", "]", "?", "NOTE:", "x", "lbq", "\t"]), min_size=1, max_size=7).map("".join), min_size=1, max_size=60))
def test_winner_equals_python(spark, values):
    rows = parse(spark, values).select("annot_idx", "pattern_type").distinct().collect()
    got = {r["annot_idx"]: r["pattern_type"] for r in rows}
    compiled = [(p.name, re.compile(p.regex, re.IGNORECASE)) for p in P.DEFAULT_PATTERNS]
    for i, v in enumerate(values):
        # a list of separators only names nothing and gives no row
        want = next((n for n, rx in compiled if rx.match(v.strip())), None)
        assert got.get(i, want) == want, v


def test_catalogue_editing():
    catalog = P.PatternCatalog()
    assert len(catalog.all()) == 23 and catalog.get("COMMENT").is_comment
    assert catalog.supported()[0] == "DOMAIN_LABEL: a domain code and its title"
    catalog.add({"name": "N", "description": "d", "regex": "x", "groups": {}})
    for bad in ({"name": "N", "description": "d", "regex": "x", "groups": {}}, {"name": "M"}, {"name": "M", "description": "", "regex": "(", "groups": {}}):
        with pytest.raises(ValueError):
            catalog.add(bad)
    catalog.remove("N")
    with pytest.raises(ValueError):
        catalog.remove("N")
    assert catalog.get("N") is None


def test_patterns_from_yaml():
    text = "annotation_patterns:\n  patterns:\n  - {name: A, description: a note, regex: '^(x)$', groups: {value: 1}}\n  - {name: B, regex: '^y$', groups: '{\"value\": 1}'}\n"
    a, b = P.load_patterns(text)
    assert a.is_comment and a.groups == {"value": 1} and not b.is_comment and b.fields == {}
    assert P.load_patterns("") == []


def test_catalogue_problems(spark):
    table = spark.createDataFrame([
        (1, "A", "x", "^a$", {"value": 1}), (2, "A", "x", "(", {"value": 0}), (3, " ", " ", "b", {}), (4, None, "x", "a", {}), (5, "C", "c", "c", {})],
        "ordinal int, name string, description string, regex string, groups map<string,int>")
    got = {(r["ordinal"], r["problem"].split(":")[0]) for r in P.catalog_problems(table).collect()}
    assert got == {(2, "Pattern name 'A' already exists"), (2, "Invalid regex pattern"), (2, "Invalid group index for 'value'"),
                   (3, "Pattern name cannot be empty"), (3, "Pattern description cannot be empty"), (4, "Missing required field")}
    assert P.catalog_problems(P.catalog_table(spark)).count() == 0
