"""Query name -> DuckDB SQL."""

from __future__ import annotations

import unicodedata

from annolake.functions import metrics as M
from annolake.functions import text as X
from annolake.operators import patterns as P
from annolake.operators import report as R
from annolake.workload import feeds as W
from annolake.workload.oracle import (ANN, BOXES, CATALOG, CLEAN, EVENT_ANN, EVENT_PAGES, EXTRACT,
                                      FINDINGS, arr, checked, parse_ctes, parsed, pick, q, values, with_)

ORACLE: dict[str, str] = {}

ORACLE["extract_positions"] = with_(ANN, EXTRACT, body="""SELECT doc_id, annot_idx, page AS "Page", content AS "Text", round(x0, 3) AS "X", round(y0, 3) AS "Y" FROM ext""")
ORACLE["extract_authors"] = with_(ANN, EXTRACT, body="""SELECT doc_id, annot_idx, page AS "Page", coalesce(author, 'Unknown') AS "Author", content AS "Content", type AS "Type",
  round(x0, 3) AS "X1", round(y0, 3) AS "Y1", round(x1, 3) AS "X2", round(y1, 3) AS "Y2" FROM ext""")

_PARSED = """SELECT study_id, doc_id, page, annot_idx, part_idx, text, pattern_type, is_comment, domain, variable_name, value, condition, label,
  test_cd_variable, test_cd_value, variable_name_end FROM ok"""
ORACLE["parse_config"] = parsed(_PARSED)
ORACLE["parse_builtin"] = parsed(_PARSED, "builtin")
ORACLE["parse_rejected"] = parsed("SELECT study_id, doc_id, page, annot_idx, part_idx, pattern_type, reason AS reject_reason FROM parsed WHERE reason IS NOT NULL")


def _study_parse(kind: str, patterns) -> str:
    studies = ", ".join(q(s) for s, k in W.STUDY_CATALOGS.items() if k == kind)
    return "SELECT * FROM (" + with_(ANN, EXTRACT.replace("WHERE ", f"WHERE study_id IN ({studies}) AND "), parse_ctes(patterns=patterns), body=_PARSED) + ")"


ORACLE["parse_by_study"] = f"""{_study_parse("default", list(P.DEFAULT_PATTERNS))} UNION ALL {_study_parse("other", W.other_patterns())}
UNION ALL SELECT * FROM ({with_(ANN, EXTRACT, body="SELECT study_id, doc_id, page, annot_idx, 0, content, NULL, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ext WHERE study_id = 'ST4'")})"""
_ENTRY = """pat AS (SELECT p_brand AS study_id, p_partkey AS ordinal, CASE WHEN p_partkey % 13 = 0 THEN ' ' WHEN p_partkey % 17 <> 0 THEN 'P' || p_partkey % 40 END AS name, p_partkey AS n FROM part),
seen AS (SELECT *, min(ordinal) OVER (PARTITION BY study_id, name) AS first FROM pat)"""
ORACLE["catalog_problems"] = with_(_ENTRY, body="""SELECT study_id, ordinal, name, problem FROM (SELECT *, unnest(CASE WHEN name IS NULL THEN ['Missing required field: name'] ELSE list_filter([
  CASE WHEN trim(name) = '' THEN 'Pattern name cannot be empty' WHEN ordinal > first THEN 'Pattern name ' || chr(39) || name || chr(39) || ' already exists' END,
  CASE WHEN n % 7 = 0 THEN 'Pattern description cannot be empty' END,
  CASE WHEN n % 5 = 0 THEN 'Invalid regex pattern: missing ), unterminated subpattern at position 0' END,
  CASE WHEN n % 4 < 2 THEN 'Invalid group index for ''value'': must be positive integer' END], lambda x: x IS NOT NULL) END) AS problem FROM seen)""")
ORACLE["variable_ranges"] = parsed(r"""SELECT study_id, doc_id, page, annot_idx, part_idx, unnest(ns) AS name, generate_subscripts(ns, 1) - 1 AS no FROM (SELECT *, CASE WHEN s1 = s2 AND d1 <> '' AND d2 <> '' AND CAST(nullif(d1, '') AS INT) <= CAST(nullif(d2, '') AS INT)
    THEN list_transform(range(CAST(nullif(d1, '') AS INT), CAST(nullif(d2, '') AS INT) + 1), lambda x: s1 || x) ELSE [variable_name, variable_name_end] END AS ns
  FROM (SELECT *, regexp_extract(variable_name, '^(.*?)(\d+)$', 1) AS s1, regexp_extract(variable_name_end, '^(.*?)(\d+)$', 1) AS s2, regexp_extract(variable_name, '^(.*?)(\d+)$', 2) AS d1,
    regexp_extract(variable_name_end, '^(.*?)(\d+)$', 2) AS d2 FROM ok WHERE variable_name_end IS NOT NULL))""")
_FIRST = P.DEFAULT_PATTERNS[0]
_TRIED = " || ';' || ".join(f"'{name}=' || regexp_extract(content, {q(_FIRST.regex)}, {g})" for name, g in sorted(_FIRST.groups.items()))
ORACLE["pattern_groups"] = with_(ANN, EXTRACT, body=f"""SELECT study_id, doc_id, page, annot_idx, hit AS matched, CASE WHEN hit THEN {_TRIED} END AS groups
  FROM (SELECT *, regexp_matches(content, '^(?:' || {q(_FIRST.regex)} || ')') AS hit FROM ext)""")
_IGNORING = FINDINGS.replace("live AS (SELECT * FROM facts WHERE pattern_type IS NOT NULL)", "live AS (SELECT * FROM facts WHERE pattern_type IS NOT NULL AND coalesce(upper(domain) NOT IN ('AE', 'LB'), true))").replace(
    "NOT has_col AND variable_name NOT IN ('STUDYID', 'USUBJID')", "NOT has_col AND variable_name NOT IN ('STUDYID', 'USUBJID', 'AGE')").replace(
    "NOT has_qnam AND upper(variable_name) NOT IN ('STUDYID', 'USUBJID')", "NOT has_qnam AND upper(variable_name) NOT IN ('STUDYID', 'USUBJID', 'AGE')").replace(
    "NOT has_supp AND upper(variable_name) NOT IN ('STUDYID', 'USUBJID')", "NOT has_supp AND upper(variable_name) NOT IN ('STUDYID', 'USUBJID', 'AGE')")
ORACLE["findings_ignoring"] = with_(ANN, EXTRACT, CATALOG, parse_ctes(), _IGNORING, body="SELECT domain, variable_name, rule_no, severity, count(*) AS n FROM f GROUP BY ALL")
_HITS = ", ".join(f"CASE WHEN regexp_matches(content, {q(p.regex)}) THEN {i} END" for i, p in enumerate(P.DEFAULT_PATTERNS, 1))
ORACLE["pattern_trials"] = with_(ANN, EXTRACT, body=f"""SELECT ordinal, ({arr([p.name for p in P.DEFAULT_PATTERNS])})[ordinal] AS pattern_type,
  count(*) AS matched, count(*) FILTER (hits[1] = ordinal) AS won, count(*) FILTER (len(hits) > 1) AS shared
  FROM (SELECT hits, unnest(hits) AS ordinal FROM (SELECT list_filter([{_HITS}], lambda h: h IS NOT NULL) AS hits FROM ext)) GROUP BY ordinal""")

ORACLE["missing_variables"] = parsed("""SELECT domain, variable_name, count(*) AS annotations, count(DISTINCT doc_id) AS documents FROM ok
  WHERE variable_name IS NOT NULL AND domain NOT LIKE 'SUPP%' AND domain IN (SELECT domain FROM ds)
  AND NOT EXISTS (SELECT 1 FROM vars v WHERE v.domain = ok.domain AND v.name = ok.variable_name) GROUP BY ALL""")
ORACLE["findings"] = checked("""SELECT study_id, doc_id, page, annot_idx, part_idx, rule_no, token_no, domain, variable_name, severity, category, message, suggested_correction FROM f""")
ORACLE["findings_similar"] = checked("SELECT study_id, doc_id, page, annot_idx, part_idx, rule_no, token_no, domain, variable_name, severity, category, message FROM f", similar=True)


def _study_catalog(study: str) -> tuple[list, str]:
    """A study's DM columns and its catalogue tables."""
    own = [d for d in W.STUDY_DATASETS if study in W.STUDIES]
    k = W.STUDIES.index(study) if own else 0
    names = {d: W.study_columns(study, d) for d in own}
    tables = (("ds(domain, label)", [(d, dict(W.DATASETS)[d]) for d in own]), ("vars(domain, ordinal, name)", [(d, i, n) for d in own for i, n in enumerate(names[d], 1)]),
              ("supp(domain, name)", [("SUPPDM", n) for n in W.QNAMS[:k + 1] if "SUPPDM" in own and "QNAM" in names["SUPPDM"]]),
              ("links(name)", [(n,) for n in W.IDVARS[:k % 2 + 1] if "RELREC" in own and "IDVAR" in names["RELREC"]]))
    width = {"ds(domain, label)": 2, "vars(domain, ordinal, name)": 3, "supp(domain, name)": 2, "links(name)": 1}
    ctes = [f"{head} AS ({values(rows)})" if rows else f"{head} AS (SELECT {', '.join(['NULL::VARCHAR'] * width[head])} WHERE false)" for head, rows in tables]
    return names.get("DM", []), ",\n".join(ctes)


def _study_check(study: str) -> str:
    dm, catalog = _study_catalog(study)
    ext = EXTRACT.replace("WHERE ", f"WHERE study_id = '{study}' AND ")
    return with_(ANN, ext, catalog, parse_ctes(dm=dm), FINDINGS_LINKED, body="SELECT study_id, rule_no, domain, message, count(*) AS n FROM f GROUP BY ALL")


#: With the rule for a RELREC dataset that has no IDVAR, which the first feed's always has.
FINDINGS_LINKED = FINDINGS.replace("domain = 'RELREC' AND ex AND condition IS NOT NULL)", "domain = 'RELREC' AND ex AND has_idvar AND condition IS NOT NULL)").replace(
    "  UNION ALL SELECT * EXCLUDE (tok, tno), 10,", "  UNION ALL SELECT *, 9, 0, 'ERROR', 'Missing Variable', 'Domain ' || domain || ' does not contain IDVAR variable.', NULL FROM live WHERE NOT is_comment AND domain = 'RELREC' AND ex AND NOT has_idvar AND condition IS NOT NULL\n  UNION ALL SELECT * EXCLUDE (tok, tno), 10,")
ORACLE["study_findings"] = " UNION ALL ".join(f"SELECT * FROM ({_study_check(s)})" for s in ("ST0", "ST1", "ST2", "ST3", "ST4"))
ORACLE["study_variables"] = "SELECT * FROM (" + values([(s, d, i, n, "character") for s in W.STUDIES for d in W.STUDY_DATASETS for i, n in enumerate(W.study_columns(s, d), 1)]) + ") AS t(study_id, domain, ordinal, name, type)"
ORACLE["unused_datasets"] = parsed("""SELECT domain AS "Dataset", 'May be using vendor/external data or oversight in annotation' AS "Possible Reason" FROM ds
  WHERE domain NOT IN (SELECT domain FROM ok WHERE domain IS NOT NULL)""")
ORACLE["variable_metadata"] = parsed("""SELECT ok.domain, ok.variable_name, CASE WHEN v.name IS NOT NULL THEN 'character' END AS variable_type, CASE WHEN v.name IS NOT NULL THEN 8 END AS variable_length,
  CASE WHEN v.name IS NOT NULL THEN upper(v.name[1:1]) || lower(v.name[2:]) END AS variable_label, count(*) AS n
  FROM ok LEFT JOIN vars v ON v.domain = ok.domain AND v.name = ok.variable_name GROUP BY ALL""")


# --- text ------------------------------------------------------------------

_UNESCAPED = "replace(replace(replace(replace(replace(html, '&amp;', chr(1)), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), chr(1), '&')"
ORACLE["clean_pages"] = f"""SELECT page_id, {CLEAN.format(_UNESCAPED)} AS text, trim(replace(replace(html, chr(13), ''), chr(10), ' ')) AS simple FROM pages"""
ORACLE["clean_documents"] = f"""SELECT doc_id, {CLEAN.format('text')} AS text FROM documents"""
_HEADER = r"(regexp_matches(content, '^[A-Z]{2}\s*=\s*.+') AND instr(content, '''') = 0 AND instr(content, '\"') = 0)".replace('\\"', '"')
_CODE = r"nullif(regexp_extract(content, '^([A-Z]{2})\s*=\s*([^=]+)$', 1), '')"
_LABEL = rf"CASE WHEN {_CODE} IS NOT NULL THEN trim(regexp_extract(content, '^([A-Z]{{2}})\s*=\s*([^=]+)$', 2)) END"
ORACLE["header_texts"] = with_(ANN, EXTRACT, body=f"""SELECT study_id, doc_id, page, annot_idx, {_HEADER} AS is_header, {_CODE} AS code, {_LABEL} AS label,
  CASE WHEN {_HEADER} THEN 12 ELSE 10 END AS font_size, CASE WHEN {_CODE} IS NOT NULL THEN content ELSE upper(content) END AS recased FROM ext""")

# What each text template turns into, written out; a lower-case domain is no header.
_QUOTED = {
    "{v} = '{l}'": '{v} = "{l}"', "{v} = {n}": '{v} = "{n}"', "{v} when {w} = HEIGHT": '{v} when {w} = "HEIGHT"',
    "{v}1 when {w} = HEIGHT": '{v}1 when {w} = "HEIGHT"', "{v},{w} when VSTESTCD=HEIGHT": '{v},{w} when VSTESTCD = "HEIGHT"',
    "{v} in SUPPAE when AGE = {n}": '{v} in SUPPAE when AGE = "{n}"', "RELID in RELREC when {v} = AESEQ": 'RELID in RELREC when {v} = "AESEQ"',
    "PFORRES,{v} when PFTESTCD = {w}": 'PFORRES,{v} when PFTESTCD = "{w}"', "{v} = '{l}' when {w} = Y": '{v} = "{l}" when {w} = "Y"',
    "{v},{w} = '{l}'": '{v},{w} = "{l}"', 'DOMAIN={d} VARIABLE={v} VALUE="{n}"': 'DOMAIN = "{d}" VARIABLE = "{v}" VALUE = "{n}"',
}


def _quoted_text() -> str:
    templates = [_QUOTED.get(t, t) for t in W.TEMPLATES]
    domain = pick(W.DOMAINS, "l_orderkey + l_linenumber")
    label = pick([" ".join(x.split()) for x in W.LABELS], "l_partkey + l_linenumber")
    text = pick(templates, "l_orderkey * 7 + l_linenumber + l_partkey")
    text = f"CASE WHEN {text} = '{{d}} = {{l}}' AND {domain} = 'ae' THEN '{{d}} = \"{{l}}\"' ELSE {text} END"
    for mark, value in (("{v}", pick(W.NAMES, "l_orderkey + l_partkey")), ("{w}", pick(W.NAMES, "l_partkey * 3 + 1")),
                        ("{d}", domain), ("{l}", label), ("{n}", "CAST(CAST(l_quantity AS INT) AS VARCHAR)")):
        text = f"replace({text}, {q(mark)}, {value})"
    return text


# bracketed and free texts keep the label's trailing blank inside the text
ORACLE["normalized_quotes"] = with_(ANN, body=f"""SELECT study_id, doc_id, page, annot_idx,
  CASE WHEN instr(content, '=') = 0 THEN {CLEAN.format('content')} ELSE {_quoted_text()} END AS content FROM ann""")

_ORDER = X.RED_DOMAINS + X.BLUE_DOMAINS
_MENTIONS = " ".join(f"WHEN contains(upper({{0}}), '{d} =') OR contains(upper({{0}}), '{d}CAT') OR contains(upper({{0}}), 'SUPP{d}') OR starts_with(upper({{0}}), '{d}') THEN '{d}'" for d in _ORDER)


def _domain(text: str) -> str:
    code = rf"nullif(regexp_extract({text}, '^([A-Z]{{2}})\s*=\s*([^=]+)$', 1), '')"
    return f"coalesce({code}, CASE {_MENTIONS.format(text)} END)"


def _word_domain(text: str) -> str:
    return rf"nullif(regexp_extract(upper({text}), '(?:^|\s)({'|'.join(_ORDER)})', 1), '')"


_RED = "('FA', 'AE', 'DS', 'DD', 'MH')"
ORACLE["text_domains"] = with_(ANN, EXTRACT, body=f"""SELECT study_id, doc_id, page, annot_idx, domain, word_domain, CASE WHEN domain IN {_RED} THEN '#FF0000' ELSE '#0000FF' END AS color
  FROM (SELECT *, {_domain('content')} AS domain, {_word_domain('content')} AS word_domain FROM ext)""")
ORACLE["document_domains"] = f"SELECT doc_id, {_domain('text')} AS domain, {_word_domain('text')} AS word_domain FROM documents"
ORACLE["condition_parts"] = parsed("""SELECT study_id, doc_id, page, annot_idx, part_idx,
  CASE WHEN len(string_split(condition, '=')) = 2 THEN trim(string_split(condition, '=')[1]) END AS left_side, CASE WHEN len(string_split(condition, '=')) = 2 THEN trim(string_split(condition, '=')[2]) END AS right_side,
  generate_subscripts(regexp_extract_all(condition, '([A-Z0-9_]+)'), 1) - 1 AS token_no, unnest(regexp_extract_all(condition, '([A-Z0-9_]+)')) AS token FROM ok WHERE condition IS NOT NULL""")
ORACLE["previews"] = """SELECT doc_id, CASE WHEN length(text) > 30 THEN text[1:30] || '...' ELSE text END AS short, CASE WHEN length(text) > 50 THEN text[1:50] || '...' ELSE text END AS longer,
  CASE WHEN length(text) > 40 THEN text[1:37] || '...' ELSE text END AS child, source AS author FROM documents"""
_HEX = "printf('#%02X%02X%02X', CAST(trunc({0} * 255) AS INT), CAST(trunc({1} * 255) AS INT), CAST(trunc({2} * 255) AS INT))"
ORACLE["author_texts"] = with_(ANN, body=f"""SELECT study_id, doc_id, page, annot_idx, CASE WHEN trim(coalesce(author, '')) = '' THEN 'Reviewer' ELSE author END AS author,
  'font-size:10.0pt;text-align:left;color:' || {_HEX.format('r', 'g', 'b')} || ';font-weight:bold;font-style:normal;font-family:Arial;font-stretch:normal' AS style,
  '(' || CAST(round(x0, 2) AS VARCHAR) || ', ' || CAST(round(y0, 2) AS VARCHAR) || ')' AS position FROM ann""")
ORACLE["document_forms"] = r"""SELECT doc_id, coalesce(CASE WHEN regexp_matches(text, 'Form:\s*(.+?)(?:\n|$)') THEN trim(regexp_extract(text, 'Form:\s*(.+?)(?:\n|$)', 1)) END,
  list_filter(list_transform(string_split(trim(text, ' ' || chr(10)), chr(10))[1:5], lambda x: trim(x)), lambda x: length(x) > 3 AND length(x) < 100)[1], 'Page ' || CAST(doc_id AS VARCHAR)) AS form FROM documents"""


# --- colours ---------------------------------------------------------------

def _standard(palette: str) -> str:
    top = "greatest(r, g, b)"
    rn, gn, bn = (f"({c} / nullif({top}, 0))" for c in "rgb")
    if palette == "v1":
        return ("CASE WHEN r < 0.5 AND b > 0.5 THEN '#0000FF' WHEN r > 0.5 AND g < 0.5 AND b < 0.5 THEN '#FF0000' WHEN r < 0.5 AND g > 0.5 AND b < 0.5 THEN '#00FF00' "
                f"WHEN r > 0.5 AND g > 0.5 AND b < 0.5 THEN '#FFA500' WHEN r < 0.3 AND g < 0.3 AND b < 0.3 THEN '#000000' ELSE {_HEX.format('r', 'g', 'b')} END")
    green = "#007C00" if palette == "v3" else "#00FF00"
    first = f"WHEN {top} = 0 THEN '#000000'" if palette == "v3" else f"WHEN {top} < 0.15 THEN '#000000'"
    orange = f"WHEN {rn} > 0.7 AND {gn} > 0.5 AND {bn} < 0.3 THEN '#FFA500'" if palette == "v2" else ""
    return (f"CASE {first} WHEN {bn} > 0.9 AND {rn} < 0.3 AND {gn} < 0.3 THEN '#0000FF' WHEN {rn} > 0.9 AND {gn} < 0.3 AND {bn} < 0.3 THEN '#FF0000' "
            f"WHEN {gn} > 0.9 AND {rn} < 0.3 AND {bn} < 0.3 THEN '{green}' {orange} WHEN {bn} > 0.8 AND {gn} > 0.8 AND {rn} < 0.2 THEN '#00FFFF' "
            f"WHEN {rn} > 0.8 AND {bn} > 0.8 AND {gn} < 0.2 THEN '#FF00FF' WHEN b > 0.8 AND r < 0.2 AND g < 0.3 THEN '#0000FF' WHEN r > 0.8 AND g < 0.2 AND b < 0.2 THEN '#FF0000' "
            f"WHEN g > 0.8 AND r < 0.2 AND b < 0.2 THEN '{green}' ELSE {_HEX.format('r', 'g', 'b')} END")


def _bands(r: str, g: str, b: str) -> str:
    near = "abs({0} - {1}) < {2}"
    rules = (("Blue", (0, .1), (0, .1), (1.0, .1)), ("Red", (1.0, .1), (0, .1), (0, .1)), ("Green", (0, .1), (0.5, .2), (0, .1)),
             ("Cyan", (0.75, .1), (1.0, .1), (1.0, .1)), ("Black", (0, .1), (0, .1), (0, .1)), ("Purple", (0.5, .2), (0, .2), (0.5, .2)), ("Orange", (1.0, .1), (0.5, .2), (0, .1)))
    whens = " ".join("WHEN " + " AND ".join(near.format(c, *band) for c, band in zip((r, g, b), bands)) + f" THEN '{name}'" for name, *bands in rules)
    return f"CASE {whens} ELSE printf('RGB(%.2f, %.2f, %.2f)', {r}, {g}, {b}) END"


def _class(r: str, g: str, b: str) -> str:
    return (f"CASE WHEN abs({r} - 1) < 0.1 AND abs({g}) < 0.1 AND abs({b}) < 0.1 THEN 'RED' WHEN abs({r}) < 0.1 AND abs({g}) < 0.1 AND abs({b} - 1) < 0.1 THEN 'BLUE' "
            f"ELSE printf('RGB(%.2f,%.2f,%.2f)', {r}, {g}, {b}) END")


_V = {p: _standard(p) for p in ("v1", "v2", "v3")}
ORACLE["standard_colors"] = with_(ANN, body=f"""SELECT *, CASE v3 WHEN '#FF0000' THEN 'RED' WHEN '#0000FF' THEN 'BLUE' WHEN '#000000' THEN 'BLACK' WHEN '#00FF00' THEN 'GREEN' ELSE 'OTHER' END AS byte_class, true AS same FROM
  (SELECT study_id, doc_id, page, annot_idx, {_HEX.format('r', 'g', 'b')} AS hex, {_V['v1']} AS v1, {_V['v2']} AS v2, {_V['v3']} AS v3,
  printf('RGB(%d, %d, %d)', CAST(trunc(r * 255) AS INT), CAST(trunc(g * 255) AS INT), CAST(trunc(b * 255) AS INT)) AS rgb, {_bands('r', 'g', 'b')} AS name, {_class('r', 'g', 'b')} AS output_class FROM ann)""")
_F = "l_linestatus = 'F'"
_IS = "(dr = {0} AND dg = {1} AND db = {2})"
_DHEX = _HEX.format("dr", "dg", "db")
_SHEX = _HEX.format("r", "g", "b")
_SKIP = " OR ".join(_IS.format(*c) for c in ((0, 1, 1), (1, 1, 1), (0.75, 1, 1), (0.85, 1, 1)))
ORACLE["text_colors"] = with_(ANN, body=f"""SELECT study_id, doc_id, page, annot_idx, CASE WHEN {_F} THEN {_DHEX} ELSE '#000000' END AS da_color,
  CASE WHEN {_F} AND NOT {_IS.format(0, 0, 0)} THEN {_DHEX} WHEN {_SKIP} OR {_IS.format(0, 0, 0)} THEN '#000000' ELSE {_DHEX} END AS export_color,
  CASE WHEN {_F} AND NOT ({_IS.format(0, 0, 0)} OR {_IS.format(1, 1, 1)}) THEN {_DHEX} ELSE '#000000' END AS archived_color, {_SHEX} AS preserve_color FROM ann""")
ORACLE["parsed_colors"] = with_(ANN, body=f"""SELECT study_id, doc_id, page, annot_idx,
  CASE type WHEN 'Square' THEN {_DHEX} WHEN 'Highlight' THEN '#00FFFF' ELSE {_SHEX} END AS fill,
  CASE type WHEN 'Highlight' THEN NULL ELSE {_SHEX} END AS style FROM ann""")
ORACLE["output_color_totals"] = with_(ANN, body=f"""SELECT study_id, count(*) AS total, count(*) FILTER (c = 'RED') AS red, count(*) FILTER (c = 'BLUE') AS blue, count(*) FILTER (c NOT IN ('RED', 'BLUE')) AS other
  FROM (SELECT study_id, CASE WHEN {_F} THEN {_class('dr', 'dg', 'db')} ELSE 'RGB(0.00,0.00,0.00)' END AS c FROM ann WHERE type = 'FreeText') GROUP BY study_id""")
_KEPT = f"""kept AS (SELECT study_id, doc_id, page, annot_idx, trim(content) AS content, round_even(r, 3) AS r, round_even(g, 3) AS g, round_even(b, 3) AS b,
  {_bands('r', 'g', 'b')} AS color_name FROM ann WHERE trim(content) <> '')"""
ORACLE["color_usage"] = with_(ANN, _KEPT, body=f"""SELECT doc_id, page, color_name, arg_min({_HEX.format('r', 'g', 'b')}, annot_idx) AS color, count(*) AS count, min(annot_idx) AS first_idx FROM kept GROUP BY ALL""")
ORACLE["color_usage_items"] = with_(ANN, _KEPT, body="""SELECT doc_id, page, min(annot_idx) OVER (PARTITION BY doc_id, page, color_name) AS first_idx, color_name, annot_idx, content FROM kept""")
ORACLE["distinct_colors"] = with_(ANN, _KEPT, body="SELECT DISTINCT color_name, r, g, b FROM kept")


# --- sizes -----------------------------------------------------------------

ORACLE["da_fonts"] = with_(ANN, body="""SELECT lower(table_font) AS font, table_size AS size, table_font, table_size, count(*) AS n
  FROM (SELECT CASE WHEN l_linestatus = 'F' THEN 'Helv' ELSE 'Cour' END AS table_font, CASE WHEN l_linestatus = 'F' THEN 10.0::DOUBLE ELSE 8.0::DOUBLE END AS table_size FROM ann) GROUP BY ALL""")
_INTS = lambda name, cols: ", ".join(f"CAST(trunc({c} * 255) AS INT) AS \"{name}_{n}\"" for c, n in zip(cols, "RGB"))
_RGB = "printf('RGB(%d, %d, %d)', CAST(trunc({0} * 255) AS INT), CAST(trunc({1} * 255) AS INT), CAST(trunc({2} * 255) AS INT))"
ORACLE["style_table"] = with_(ANN, body=f"""SELECT study_id, doc_id, annot_idx, page AS "Page", {CLEAN.format('content')} AS "Content", {_RGB.format('tr', 'tg', 'tb')} AS "Text_Color", {_INTS('Text_Color', ('tr', 'tg', 'tb'))},
  'RGB(0, 255, 255)' AS "Background_Color", 0 AS "Background_R", 255 AS "Background_G", 255 AS "Background_B", {_RGB.format('r', 'g', 'b')} AS "Border_Color", {_INTS('Border', ('r', 'g', 'b'))},
  1.0::DOUBLE AS "Border_Width", 'S' AS "Border_Style", round(x0, 3) AS "Position_X0", round(y0, 3) AS "Position_Y0", round(x1, 3) AS "Position_X1", round(y1, 3) AS "Position_Y1",
  round(x1 - x0, 3) AS "Width", round(y1 - y0, 3) AS "Height", CASE WHEN {_F} THEN 'Helv' ELSE 'Cour' END AS "Font_Name", CASE WHEN {_F} THEN 10.0::DOUBLE ELSE 8.0::DOUBLE END AS "Font_Size",
  coalesce(author, '') AS "Author", '' AS "Subject", '' AS "Creation_Date", '' AS "Modification_Date"
  FROM (SELECT *, CASE WHEN {_F} THEN dr ELSE 0 END AS tr, CASE WHEN {_F} THEN dg ELSE 0 END AS tg, CASE WHEN {_F} THEN db ELSE 0 END AS tb FROM ann WHERE type = 'FreeText')""")


def _units(text: str, widths, default: int) -> str:
    """Width by width class: what vanishes from the text when a class is deleted."""
    terms = []
    for width, chars in widths.items():
        accented = "".join(chr(c) for c in range(0xC0, 0x100) if unicodedata.normalize("NFD", chr(c))[0] in chars and unicodedata.normalize("NFD", chr(c))[0] != chr(c))
        terms.append(f"{width - default} * (length({text}) - length(translate({text}, {q(chars + accented)}, '')))")
    return f"({default} * length({text}) + {' + '.join(terms)})"


def _bold(text: str) -> str:
    return _units(text, M.HELVETICA_BOLD, 278)


_WRAP = f"""words AS (SELECT *, list_transform(string_split(content, ' '), lambda w: {{'w': w, 'n': {_bold('w')} / 100.0}}) AS ws, x1 - x0 AS lim, y1 - y0 AS hgt, {_bold('content')} / 100.0 AS line FROM ext),
wrap AS (SELECT *, list_reduce(list_prepend({{'lines': CAST([] AS VARCHAR[]), 'cur': '', 'n': 0.0, 'widest': 0.0, 'w': '', 'wn': 0.0}},
    list_transform(ws, lambda t: {{'lines': CAST([] AS VARCHAR[]), 'cur': '', 'n': 0.0, 'widest': 0.0, 'w': t.w, 'wn': t.n}})),
  lambda a, t: CASE
    WHEN a.cur = '' AND t.wn <= lim - 8 THEN {{'lines': a.lines, 'cur': t.w, 'n': t.wn, 'widest': a.widest, 'w': '', 'wn': 0.0}}
    WHEN a.cur = '' THEN {{'lines': list_append(a.lines, t.w), 'cur': '', 'n': 0.0, 'widest': greatest(a.widest, t.wn), 'w': '', 'wn': 0.0}}
    WHEN a.n + 2.78 + t.wn <= lim - 8 THEN {{'lines': a.lines, 'cur': a.cur || ' ' || t.w, 'n': a.n + 2.78 + t.wn, 'widest': a.widest, 'w': '', 'wn': 0.0}}
    ELSE {{'lines': list_append(a.lines, a.cur), 'cur': t.w, 'n': t.wn, 'widest': greatest(a.widest, a.n), 'w': '', 'wn': 0.0}} END) AS z FROM words),
boxed AS (SELECT *, CASE WHEN z.cur = '' THEN z.lines ELSE list_append(z.lines, z.cur) END AS lines, greatest(z.widest, z.n) AS widest,
  CASE WHEN lim - 8 <= 0 THEN lim * 0.8 ELSE lim - 8 END AS room FROM wrap),
sized AS (SELECT *, CASE WHEN line <= room THEN line + 8 ELSE lim END AS lw, CASE WHEN line <= room THEN 16.0 ELSE greatest(1, CAST(floor(line / room + 0.5) AS INT)) * 12.0 + 4 END AS lh FROM boxed)"""
ORACLE["text_boxes"] = with_(ANN, EXTRACT, _WRAP, body=f"""SELECT study_id, doc_id, page, annot_idx, round(line, 3) AS line, round(line + 8, 3) AS plain_width, 16.0::DOUBLE AS plain_height,
  round(lw, 3) AS limited_width, lh::DOUBLE AS limited_height, round(least(lim, widest + 8), 3) AS wrapped_width, (len(lines) * 12.0 + 4)::DOUBLE AS wrapped_height, array_to_string(lines, '|') AS lines,
  lw <= lim + 0.5 AND lh <= hgt + 0.5 AS fits, round({_units('content', M.HELVETICA, 278)} * 8 / 1000.0, 3) AS helvetica, round((length(content) * 4.8)::DOUBLE, 3) AS courier FROM sized""")
ORACLE["document_widths"] = f"SELECT doc_id, round({_bold('text')} / 100.0, 2) AS width FROM documents"


# --- reports ---------------------------------------------------------------

_SEV = "[{'ord': 0, 's': 'ERROR'}, {'ord': 1, 's': 'WARNING'}, {'ord': 2, 's': 'INFO'}]"


def _severity(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {lead}v.ord AS ord, v.s AS severity, CASE v.s WHEN 'ERROR' THEN e WHEN 'WARNING' THEN w ELSE i END AS count,
  printf('%.1f%%', CASE v.s WHEN 'ERROR' THEN e WHEN 'WARNING' THEN w ELSE i END / n * 100) AS percent
  FROM (SELECT {lead}count(*) AS n, count(*) FILTER (severity = 'ERROR') AS e, count(*) FILTER (severity = 'WARNING') AS w, count(*) FILTER (severity = 'INFO') AS i, unnest({_SEV}) AS v FROM f {group})"""


_METRICS = """count(*) AS total_issues, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings,
  count(*) FILTER (severity = 'INFO') AS infos, count(DISTINCT domain) AS unique_domains, count(DISTINCT variable_name) AS unique_variables"""


def _top(column: str, n: int, by: str = "", errors: bool = False) -> str:
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    total = f"sum(count(*)) OVER ({part})" if column == "category" else (
        f"(SELECT count(*) FROM f g WHERE g.{by} = f.{by})" if by else "(SELECT count(*) FROM f)")
    having = "HAVING bool_or(severity = 'ERROR')" if errors else ""
    return f"""SELECT {lead}rank, {column}, count, printf('%.1f%%', count / total * 100) AS percent FROM (
  SELECT {lead}{column}, count, total, row_number() OVER ({part} ORDER BY count DESC, seen) AS rank FROM (
  SELECT {lead}{column}, count(*) AS count, {total} AS total, min((study_id, doc_id, page, annot_idx, part_idx, rule_no, token_no)) AS seen
  FROM f WHERE {column} IS NOT NULL GROUP BY {lead}{column} {having})) WHERE rank <= {n}"""


ORACLE["severity_totals"] = checked(_severity())
ORACLE["study_severity_totals"] = checked(_severity("study_id"))
ORACLE["key_metrics"] = checked(f"SELECT study_id, {_METRICS} FROM f GROUP BY study_id")
ORACLE["category_counts"] = checked("SELECT category, count(*) AS count FROM f GROUP BY category")
ORACLE["domain_counts"] = checked("SELECT study_id, domain, count(*) AS count FROM f WHERE domain IS NOT NULL GROUP BY ALL")
ORACLE["category_severity_summary"] = checked("SELECT category, severity, count(*) AS count, round_even(count(*) / sum(count(*)) OVER () * 100, 1) AS percentage FROM f GROUP BY category, severity")
ORACLE["annotation_types"] = with_(ANN, body="SELECT doc_id, type, count(*) AS count FROM ann GROUP BY ALL")
ORACLE["dataset_coverage"] = parsed("""SELECT domain, count(*) AS variables, count(*) FILTER (named) AS referenced, count(*) FILTER (NOT named) AS unused, round_even(count(*) FILTER (named) / count(*) * 100, 1) AS percent
  FROM (SELECT domain, name, EXISTS (SELECT 1 FROM ok WHERE ok.domain = vars.domain AND ok.variable_name = vars.name) AS named FROM vars) GROUP BY domain""")
ORACLE["top_categories"] = checked(_top("category", 5))
ORACLE["top_domains"] = checked(_top("domain", 5, "study_id"))
ORACLE["top_error_domains"] = checked(_top("domain", 2, "doc_id", True))
_EACH = "[('Total Issues', total_issues), ('Errors', errors), ('Warnings', warnings), ('Info', infos), ('Unique Domains', unique_domains), ('Unique Variables', unique_variables)]"
ORACLE["dashboard"] = checked(f"""SELECT 'Key Metrics' AS section, i - 1 AS ord, names[i] AS label, CAST(vals[i] AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS percent
  FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i, ['Total Issues', 'Errors', 'Warnings', 'Info', 'Unique Domains', 'Unique Variables'] AS names, [total_issues, errors, warnings, infos, unique_domains, unique_variables] AS vals FROM (SELECT {_METRICS} FROM f))
  UNION ALL SELECT 'Distribution by Severity', ord, severity, CAST(count AS VARCHAR), percent FROM ({_severity()})
  UNION ALL SELECT 'Most Common Issues', rank, category, CAST(count AS VARCHAR), percent FROM ({_top('category', 5)})
  UNION ALL SELECT 'Top Domains with Issues', rank, domain, CAST(count AS VARCHAR), percent FROM ({_top('domain', 5)})
  UNION ALL SELECT 'Summary', 0, 'Found ' || (SELECT count(*) FROM f WHERE severity = 'ERROR') || ' critical errors requiring attention. Focus on fixing ''' ||
    (SELECT string_agg(category, ', ' ORDER BY rank) FROM ({_top('category', 2, '', True)})) || ''' issues in the ' || (SELECT string_agg(domain, ', ' ORDER BY rank) FROM ({_top('domain', 2, '', True)})) || ' domain(s).', NULL, NULL""")
_FK = "study_id, doc_id, annot_idx, part_idx, rule_no, token_no"
ORACLE["report_details"] = checked(f"""SELECT {_FK}, page AS "Page", text AS "Original Annotation", domain AS "Domain", variable_name AS "Variable", value AS "Value", category AS "Category", severity AS "Severity", message AS "Message",
  suggested_correction AS "Suggested Correction", '2024-01-01 00:00:00' AS "Timestamp" FROM f""")
ORACLE["report_overview"] = checked(f"""SELECT {_FK}, page AS "Page", text AS "Annotation Text", domain AS "Domain", label AS "Label", variable_name AS "Variable", value AS "Value", severity AS "Validation Status",
  coalesce(pattern_type, 'None') AS "Pattern Type" FROM f""")
ORACLE["report_unmatched"] = checked(f"""SELECT {_FK}, page AS "Page", text AS "Annotation Text", '(' || CAST(round(x0, 2) AS VARCHAR) || ', ' || CAST(round(y0, 2) AS VARCHAR) || ')' AS "Position",
  '2024-01-01 00:00:00' AS "Timestamp" FROM f WHERE pattern_type IS NULL AND text <> ''""")
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


def _report(head, summary, middle, block, foot) -> str:
    n = {"n": "count(*)", "ERROR": "count(*) FILTER (severity = 'ERROR')", "WARNING": "count(*) FILTER (severity = 'WARNING')", "INFO": "count(*) FILTER (severity = 'INFO')"}
    frame = [q(h) for h in head] + [f"{q(a)} || CAST({n[c]} AS VARCHAR) || {q(z)}" for a, c, z in summary] + [q(m) for m in middle]
    out = f"""SELECT 0 AS section, i - 1 AS line_no, ls[i] AS line, 1 AS n FROM (SELECT [{', '.join(frame)}] AS ls, unnest(range(1, {len(frame) + 1})) AS i FROM f)
  UNION ALL SELECT 1, i - 1, ls[i], count(*) FROM (SELECT [{', '.join(block)}] AS ls, unnest(range(1, {len(block) + 1})) AS i FROM f) GROUP BY ALL"""
    if foot:
        out += f" UNION ALL SELECT 2, i - 1, ls[i], 1 FROM (SELECT [{', '.join(q(x) for x in foot)}] AS ls, unnest(range(1, {len(foot) + 1})) AS i)"
    return checked(out)


ORACLE["report_text"] = _report(
    ["SDTM Validation Report", "=" * 50, "", "Summary", "-" * 20],
    [("Total Annotations: ", "n", ""), ("Errors: ", "ERROR", ""), ("Warnings: ", "WARNING", ""), ("Info: ", "INFO", "")],
    ["", "Detailed Results", "-" * 20],
    ["'Domain: ' || coalesce(domain, '')", "'Variable: ' || coalesce(variable_name, '')", "'Severity: ' || severity", "'Message: ' || message", "''"], [])
ORACLE["report_html"] = _report(
    R.HTML_HEAD,
    [("<tr><th>Total Annotations</th><td>", "n", "</td></tr>"), ("<tr><th>Errors</th><td class='error'>", "ERROR", "</td></tr>"),
     ("<tr><th>Warnings</th><td class='warning'>", "WARNING", "</td></tr>"), ("<tr><th>Info</th><td class='info'>", "INFO", "</td></tr>")],
    ["</table>", "<h2>Detailed Results</h2>", "<table>", "<tr><th>Domain</th><th>Variable</th><th>Severity</th><th>Message</th></tr>"],
    ["'<tr>'", f"'<td>' || {_ESC.format('coalesce(domain, ' + q('') + ')')} || '</td>'", f"'<td>' || {_ESC.format('coalesce(variable_name, ' + q('') + ')')} || '</td>'",
     "'<td class=''' || lower(severity) || '''>' || severity || '</td>'", f"'<td>' || {_ESC.format('message')} || '</td>'", "'</tr>'"],
    ["</table>", "</body>", "</html>"])


# --- catalogue look-ups ----------------------------------------------------

ORACLE["supplemental_names"] = """SELECT p_brand AS brand, upper(p_type) AS name, count(*) AS missing FROM part p
  WHERE NOT EXISTS (SELECT 1 FROM part k WHERE k.p_size >= 48 AND k.p_brand = p.p_brand AND upper(k.p_type) = upper(p.p_type)) GROUP BY ALL"""
ORACLE["record_links"] = """WITH t AS (SELECT o_custkey, unnest(regexp_extract_all(upper(o_orderpriority), '([A-Z0-9_]+)')) AS idvar FROM orders)
  SELECT idvar, count(*) AS missing FROM t WHERE NOT EXISTS (SELECT 1 FROM orders k WHERE k.o_orderstatus = 'O' AND k.o_custkey = t.o_custkey
  AND upper(string_split(k.o_orderpriority, '-')[-1]) = t.idvar) GROUP BY idvar"""
ORACLE["label_compare"] = """SELECT s_suppkey, CASE WHEN n_name IS NULL THEN 'Wrong Domain' WHEN s_acctbal > 5000 AND 'NATION_' || s_nationkey = n_name THEN 'ok' ELSE 'Metadata Mismatch' END AS outcome
  FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey"""


# --- layout ----------------------------------------------------------------

def _mean_groups(name: str, at: str, tolerance: float, source: str = "bx") -> str:
    near = f"abs(p.pt - r.s / r.n) <= {tolerance}"
    return f"""{name}_p AS (SELECT doc_id, page, annot_idx, {at} AS pt, row_number() OVER (PARTITION BY doc_id, page ORDER BY {at}, annot_idx) AS rn FROM {source}),
{name}_r AS (SELECT doc_id, page, annot_idx, pt, rn, CAST(pt AS DOUBLE) AS s, 1 AS n, 0 AS g FROM {name}_p WHERE rn = 1
  UNION ALL SELECT p.doc_id, p.page, p.annot_idx, p.pt, p.rn, CASE WHEN {near} THEN r.s + p.pt ELSE p.pt END, CASE WHEN {near} THEN r.n + 1 ELSE 1 END, CASE WHEN {near} THEN r.g ELSE r.g + 1 END
  FROM {name}_r r JOIN {name}_p p ON p.doc_id = r.doc_id AND p.page = r.page AND p.rn = r.rn + 1),
{name} AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY g) - 1 AS no FROM (SELECT doc_id, page, annot_idx, pt, g, count(*) OVER (PARTITION BY doc_id, page, g) AS size, avg(pt) OVER (PARTITION BY doc_id, page, g) AS mean FROM {name}_r) WHERE size >= 2)"""


def _fit_groups(name: str, at: str, tolerance: float, source: str = "bx") -> str:
    hit = f"list_position(list_transform(r.f, lambda z: abs(p.pt - z) <= {tolerance}), true)"
    return f"""{name}_p AS (SELECT doc_id, page, annot_idx, CAST({at} AS DOUBLE) AS pt, row_number() OVER (PARTITION BY doc_id, page ORDER BY annot_idx) AS rn FROM {source}),
{name}_r AS (SELECT doc_id, page, annot_idx, pt, rn, [pt] AS f, CAST(1 AS BIGINT) AS g FROM {name}_p WHERE rn = 1
  UNION ALL SELECT p.doc_id, p.page, p.annot_idx, p.pt, p.rn, CASE WHEN coalesce({hit}, 0) > 0 THEN r.f ELSE list_append(r.f, p.pt) END, CASE WHEN coalesce({hit}, 0) > 0 THEN CAST({hit} AS BIGINT) ELSE CAST(len(r.f) + 1 AS BIGINT) END
  FROM {name}_r r JOIN {name}_p p ON p.doc_id = r.doc_id AND p.page = r.page AND p.rn = r.rn + 1),
{name} AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY g) - 1 AS no FROM (SELECT doc_id, page, annot_idx, pt, g, count(*) OVER (PARTITION BY doc_id, page, g) AS size, avg(pt) OVER (PARTITION BY doc_id, page, g) AS mean FROM {name}_r) WHERE size >= 2)"""


def _rec(*ctes: str, body: str) -> str:
    return with_(*ctes, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


_GROUP = 'SELECT DISTINCT doc_id, page, CAST(pt AS DOUBLE) AS "at", no AS group_id, size AS group_size, round(mean, 6) AS group_mean FROM h'
ORACLE["row_groups"] = _rec(BOXES, _mean_groups("h", "y0", 10), body=_GROUP)
ORACLE["column_groups"] = _rec(BOXES, _mean_groups("h", "x0", 10), body=_GROUP)
_FREE = "(SELECT * FROM bx WHERE type = 'FreeText')"
ORACLE["first_fit_groups"] = _rec(BOXES, _fit_groups("h", "y0", 10, _FREE), body=_GROUP)


def _moved(far: str) -> str:
    return f"""mv AS (SELECT b.*, coalesce(abs(b.y0 - h.mean) {far}, false) AS h_moved, coalesce(abs(b.x0 - v.mean) {far}, false) AS v_moved, h.mean AS hm, v.mean AS vm, h.no AS hg, v.no AS vg
  FROM bx b LEFT JOIN h ON h.doc_id = b.doc_id AND h.annot_idx = b.annot_idx LEFT JOIN v ON v.doc_id = b.doc_id AND v.annot_idx = b.annot_idx),
al AS (SELECT *, CASE WHEN v_moved THEN vm ELSE x0 END AS nx, CASE WHEN h_moved THEN hm ELSE y0 END AS ny FROM mv)"""


_ALIGNED = "SELECT doc_id, annot_idx, h_moved, v_moved, round(nx, 4) AS x0, round(ny, 4) AS y0, round(nx + 60, 4) AS x1, round(ny + 12, 4) AS y1 FROM al"
_MEANS = (BOXES, _mean_groups("h", "y0", 10), _mean_groups("v", "x0", 10), _moved(">= 0.5"))
ORACLE["aligned_boxes"] = _rec(*_MEANS, body=_ALIGNED)
_POOL = "(SELECT * FROM bx WHERE type = 'FreeText' AND page NOT IN (2, 3))"
ORACLE["aligned_export_boxes"] = _rec(BOXES, _fit_groups("h", "y0", 1, _POOL), _fit_groups("v", "x0", 10, _POOL), _moved("> 0.5"), body=_ALIGNED)
ORACLE["alignment_totals"] = _rec(*_MEANS, body="""SELECT doc_id, count(*) AS total_annotations, count(DISTINCT (page, hg)) FILTER (hg IS NOT NULL) AS horizontal_groups, count(DISTINCT (page, vg)) FILTER (vg IS NOT NULL) AS vertical_groups,
  count(*) FILTER (h_moved) AS horizontal_aligned, count(*) FILTER (v_moved) AS vertical_aligned FROM al GROUP BY doc_id""")
_LINE = "'Page ' || page || ' [Group ' || {2} || ']: ''' || CASE WHEN length(content) > 30 THEN content[1:30] || '...' ELSE content END || ''' aligned {0} ' || printf('(%.1f, %.1f) -> (%.1f, %.1f)', {1}) AS line"
ORACLE["alignment_report"] = _rec(*_MEANS, body=f"""SELECT doc_id, page, 'horizontal' AS alignment_type, annot_idx, {_LINE.format('horizontally', 'x0, y0, x0, ny', 'hg')} FROM al WHERE h_moved
  UNION ALL SELECT doc_id, page, 'vertical', annot_idx, {_LINE.format('vertically', 'x0, ny, nx, ny', 'vg')} FROM al WHERE v_moved""")

_BAR = "repeat('=', 80)"
_REPORT = f"""tot AS (SELECT doc_id, count(*) AS n, count(DISTINCT (page, hg)) FILTER (hg IS NOT NULL) AS hs, count(DISTINCT (page, vg)) FILTER (vg IS NOT NULL) AS vs,
  count(*) FILTER (h_moved) AS hm, count(*) FILTER (v_moved) AS vm FROM al GROUP BY doc_id),
op AS (SELECT doc_id, page, 1 AS part, annot_idx, {_LINE.format('horizontally', 'x0, y0, x0, ny', 'hg')} FROM al WHERE h_moved
  UNION ALL SELECT doc_id, page, 2, annot_idx, {_LINE.format('vertically', 'x0, ny, nx, ny', 'vg')} FROM al WHERE v_moved),
blk AS (SELECT doc_id, 0 AS section, 0 AS page, 0 AS part, -1::BIGINT AS annot_idx, [{_BAR}, 'ANNOTATION ALIGNMENT REPORT', {_BAR}, '', 'Summary: Total annotations: ' || n || ', Horizontal groups: ' || hs ||
    ', Vertical groups: ' || vs || ', Horizontal aligned: ' || hm || ', Vertical aligned: ' || vm || ', Errors: 0', ''] || CASE WHEN hm + vm > 0 THEN ['Alignment Operations:', repeat('-', 80)] ELSE [] END AS ls FROM tot
  UNION ALL SELECT doc_id, 2, 0, 0, -1, CASE WHEN hm + vm > 0 THEN ['', {_BAR}] ELSE [{_BAR}] END FROM tot
  UNION ALL SELECT doc_id, 1, page, 0, -1, ['', 'Page ' || page || ':'] FROM (SELECT DISTINCT doc_id, page FROM op)
  UNION ALL SELECT doc_id, 1, page, part, -1, ['  ' || ['Horizontal', 'Vertical'][part] || ' alignments: ' || count(*)] FROM op GROUP BY doc_id, page, part
  UNION ALL SELECT doc_id, 1, page, part, annot_idx, ['    ' || line] FROM op)"""
ORACLE["alignment_report_lines"] = _rec(*_MEANS, _REPORT, body="SELECT doc_id, section, page, part, annot_idx, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM blk")


def _need(line: str, size: str) -> str:
    """CTE ``nd``: box, width of the text and whether it fits, for every annotation."""
    return f"""nd AS (SELECT *, CASE WHEN line <= room THEN line + 8 ELSE w END <= w + 0.5 AND CASE WHEN line <= room THEN 1 ELSE greatest(1, CAST(floor(line / room + 0.5) AS INT)) END * (size * 1.2) + 4 <= h + 0.5 AS fits FROM (
  SELECT *, CASE WHEN w - 8 <= 0 THEN w * 0.8 ELSE w - 8 END AS room FROM (SELECT *, x1 - x0 AS w, y1 - y0 AS h, ({line})::DOUBLE AS line, ({size})::DOUBLE AS size FROM (
  SELECT * REPLACE ({CLEAN.format('content')} AS content) FROM ann))))"""


def _resized(new_w: str, new_h: str, checked: str, extra: str = "", test: str = "abs(nw - w) >= 1 OR abs(nh - h) >= 1") -> str:
    return f"""rs AS (SELECT *, {checked} AS checked, {checked} {extra} AND ({test}) AS changed FROM (SELECT *, {new_w} AS nw, {new_h} AS nh FROM nd))"""


_SIZES = "SELECT doc_id, annot_idx, checked, changed, round(x0, 4) AS x0, round(y0, 4) AS y0, round(CASE WHEN changed THEN x0 + nw ELSE x1 END, 4) AS x1, round(CASE WHEN changed THEN y0 + nh ELSE y1 END, 4) AS y1 FROM rs"
_OWN = (f"CASE WHEN {_F} THEN {_units('content', M.HELVETICA, 278)} / 100.0 ELSE length(content) * 4.8 END", f"CASE WHEN {_F} THEN 10 ELSE 8 END")
_STD_SIZE = f"CASE WHEN {_HEADER} THEN 12 ELSE 10 END"
_STD = (f"{_bold('content')} * {_STD_SIZE} / 1000.0", _STD_SIZE)
_BOX_RS = (ANN, _need(*_OWN), _resized("w + least(line + 8 - w, 200)", "h + least(size * 1.2 + 4 - h, 300)", "type = 'FreeText'", "AND NOT fits"))
ORACLE["resized_box_font"] = with_(*_BOX_RS, body=_SIZES)
ORACLE["resize_totals"] = with_(*_BOX_RS, body="""SELECT doc_id, count(*) AS total_annotations, count(*) FILTER (type = 'FreeText') AS freetext_annotations, count(*) FILTER (checked) AS checked,
  count(*) FILTER (changed) AS resized, count(*) FILTER (checked AND NOT changed) AS skipped FROM rs GROUP BY doc_id""")


def _std_rs(checked: str):
    return (ANN, _need(*_STD), _resized("w + greatest(0, least(line + 8 - w, 200))", "h + greatest(0, least(size * 1.2 + 4 - h, 300))", checked, "AND NOT fits"))


ORACLE["resized_standard"] = with_(*_std_rs("(type = 'FreeText' AND page <> 7)"), body=_SIZES)
_EXPORT_RS = (ANN, _need(*_STD), _resized("greatest(w, line + 8) + 5", "h", "type = 'FreeText'", "", "abs(nw - w) > 1"))
ORACLE["resized_export"] = with_(*_EXPORT_RS, body=_SIZES)
ORACLE["resize_report"] = with_(*_std_rs("type = 'FreeText'"), body=f"""SELECT doc_id, annot_idx, 'Page ' || page || ': ''' || CASE WHEN length(content) > 50 THEN content[1:50] || '...' ELSE content END || ''' [' ||
  CASE WHEN {_F} THEN 'helv 10.0' ELSE 'cour 8.0' END || 'pt] ' || printf('(%.1fx%.1f) -> (%.1fx%.1f)', x1 - x0, y1 - y0, (x0 + nw) - x0, (y0 + nh) - y0) AS line FROM rs WHERE changed""")
ORACLE["skip_pages"] = r"""SELECT event_id, no AS entry_no, entry, CASE WHEN valid THEN CAST(entry AS INT) END AS skip_page, valid FROM (SELECT *, regexp_matches(entry, '^[+-]?\d+$') AND coalesce(TRY_CAST(entry AS INT) BETWEEN 1 AND 60, false) AS valid FROM (
  SELECT event_id, unnest(es) AS entry, generate_subscripts(es, 1) - 1 AS no FROM (SELECT event_id, list_filter(list_transform(string_split(user_id || ', 5, x,' || (event_id % 90) || ', ', ','), lambda s: trim(s)), lambda s: s <> '') AS es FROM events)))"""


# --- forms and bookmarks ---------------------------------------------------

_FORMS = """fm AS (SELECT doc_id, page, CASE WHEN value < 5 THEN event_type || ' log' WHEN value < 8 THEN 'Page ' || page ELSE title END AS form, value >= 8 AS marked FROM pg)"""


def _runs(name: str, source: str) -> str:
    return f"""{name} AS (SELECT doc_id, page, form FROM (SELECT *, lag(form) OVER (PARTITION BY doc_id ORDER BY page) AS prev FROM {source}) WHERE prev IS NULL OR prev <> form)"""


_HEADS = rf"""hd AS (SELECT doc_id, page, annot_idx, {_CODE} AS domain, {_LABEL} AS label FROM ea WHERE {_CODE} IS NOT NULL)"""
_FIRST = """fd AS (SELECT doc_id, domain, min(page) AS first_page, arg_min(label, page) AS label FROM hd GROUP BY ALL)"""
ORACLE["form_runs"] = with_(EVENT_PAGES, _FORMS, _runs("rn", "fm"), body="SELECT * FROM rn")
ORACLE["first_pages"] = with_(EVENT_ANN, _HEADS, _FIRST, body="SELECT * FROM fd")
_BELOW = """bl AS (SELECT DISTINCT x.doc_id, x.domain, x.run_page, rn.form FROM (SELECT h.doc_id, h.domain, (SELECT max(r.page) FROM rn r WHERE r.doc_id = h.doc_id AND r.page <= h.page) AS run_page FROM {0} h) x
  JOIN rn ON rn.doc_id = x.doc_id AND rn.page = x.run_page)"""


def _toc(source: str, section: int, level: int, title: str, page: str, domain: str = "''", sort_page: str = "0", order: str = "0") -> str:
    return f"SELECT doc_id, {section} AS section, {domain} AS domain, {sort_page} AS sort_page, {order} AS ord, {level} AS level, {title} AS title, {page} AS page FROM {source}"


def _all(*parts: str) -> str:
    return "\nUNION ALL ".join(parts)


ORACLE["standard_bookmarks"] = with_(EVENT_PAGES, EVENT_ANN, _FORMS, _runs("rn", "fm"), _HEADS, _FIRST, _BELOW.format("hd"), body=_all(
    _toc("(SELECT DISTINCT doc_id FROM rn)", 1, 1, "'Form_bookmarks'", "1"), _toc("rn", 1, 2, "form", "page", sort_page="page"),
    _toc("(SELECT DISTINCT doc_id FROM fd)", 2, 1, "'SDTM'", "1"), _toc("fd", 2, 2, "domain", "first_page", "domain"),
    _toc("bl", 2, 3, "form", "run_page", "domain", "run_page")))
_SHEADS = r"""sh AS (SELECT doc_id, page, trim(string_split(content, '=')[1]) AS domain FROM ea WHERE regexp_matches(trim(content), '^[A-Z]{2}\s*=\s*[A-Z\s]+$'))"""
ORACLE["script_bookmarks"] = with_(EVENT_PAGES, EVENT_ANN, _FORMS, _runs("rn", "(SELECT * FROM fm WHERE marked)"), _SHEADS, _BELOW.format("sh"), body=_all(
    _toc("(SELECT DISTINCT doc_id FROM pg)", 1, 1, "'Form_bookmarks'", "1"), _toc("rn", 1, 2, "form", "page", sort_page="page"),
    _toc("(SELECT DISTINCT doc_id FROM pg)", 2, 1, "'SDTM'", "1"), _toc("(SELECT doc_id, domain, min(run_page) AS fp FROM bl GROUP BY ALL)", 2, 2, "domain", "fp", "domain"),
    _toc("bl", 2, 3, "form", "run_page", "domain", "run_page")))
ORACLE["xfdf_bookmarks"] = with_(EVENT_PAGES, EVENT_ANN, _FORMS, _HEADS, _FIRST, body=_all(
    _toc("(SELECT 'U' || user_id AS doc_id, event_id FROM events WHERE event_type = 'signup' AND value <= 30 AND 'U' || user_id IN (SELECT doc_id FROM fd))", 0, 1, "'Contents'", "1", order="event_id"),
    _toc("(SELECT DISTINCT doc_id FROM fd)", 2, 1, "'SDTM'", "1"), _toc("fd", 2, 2, "domain || ' - ' || label", "first_page", "domain"),
    _toc("(SELECT DISTINCT h.doc_id, h.domain, h.page, form FROM hd h JOIN fm ON fm.doc_id = h.doc_id AND fm.page = h.page)", 2, 3, "'Page ' || page || ' - ' || form", "page", "domain", "page")))


def _items(source: str, prelude: tuple, text: str = "content") -> str:
    code = rf"nullif(regexp_extract({text}, '^([A-Z]{{2}})\s*=\s*([^=]+)$', 1), '')"
    label = rf"CASE WHEN {code} IS NOT NULL THEN trim(regexp_extract({text}, '^([A-Z]{{2}})\s*=\s*([^=]+)$', 2)) END"
    return with_(*prelude, f"""it AS (SELECT * FROM (SELECT doc_id, page, annot_idx, {code} AS code, {label} AS label, upper({text}) AS item, coalesce({code}, {_word_domain(text)}) AS domain FROM {source}) WHERE domain IS NOT NULL),
fi AS (SELECT doc_id, domain, min(page) AS first_page, arg_min(label, (page, annot_idx)) FILTER (code IS NOT NULL) AS label FROM it GROUP BY ALL),
tx AS (SELECT *, row_number() OVER (PARTITION BY doc_id, domain ORDER BY page, annot_idx) AS no FROM (SELECT doc_id, domain, item, unnest(min((page, annot_idx))::STRUCT(page INT, annot_idx BIGINT)) FROM it WHERE code IS NULL GROUP BY doc_id, domain, item))""",
        body=_all(_toc("(SELECT DISTINCT doc_id FROM fi)", 2, 1, "'SDTM'", "1"),
                  _toc("fi", 2, 2, "CASE WHEN label IS NOT NULL THEN domain || ' - ' || label ELSE domain END", "first_page", "domain"),
                  _toc("(SELECT tx.* FROM tx JOIN fi ON fi.doc_id = tx.doc_id AND fi.domain = tx.domain WHERE no <= 10 AND fi.label IS NOT NULL)", 2, 3,
                       "CASE WHEN length(item) > 40 THEN item[1:37] || '...' ELSE item END", "page", "domain", "0", "no")))


ORACLE["item_bookmarks"] = _items("ea", (EVENT_ANN,))
ORACLE["preserved_bookmarks"] = _items("kept", (ANN, _KEPT))


# --- standardize jobs ------------------------------------------------------

_QTEXT = f"CASE WHEN instr(content, '=') = 0 THEN {CLEAN.format('content')} ELSE {_quoted_text()} END"


def _on_da(sql: str) -> str:
    """A colour rule over r, g, b applied to the channels written in the DA text."""
    return f"(SELECT {sql} FROM (SELECT dr AS r, dg AS g, db AS b))"


# the export rule starts from the DA colour, or the appearance text when that is black; both hold the same numbers
_BLACKISH = f"({_SKIP} OR {_IS.format(0, 0, 0)})"
_EXPORT_COLOR = f"CASE WHEN {_F} AND NOT {_IS.format(0, 0, 0)} THEN {_on_da(_standard('v3'))} WHEN {_BLACKISH} THEN '#000000' ELSE {_on_da(_standard('v3'))} END"
_EXPORT = f"""ex AS (SELECT *, {_EXPORT_COLOR} AS text_hex, {_QTEXT} AS text FROM ann WHERE type = 'FreeText'),
exs AS (SELECT *, CASE WHEN {_HEADER.replace('content', 'text')} THEN 12 ELSE 10 END AS size FROM ex),
exw AS (SELECT *, {_bold('text')} * size / 1000.0 AS line FROM exs)"""
ORACLE["export_rows"] = with_(ANN, _EXPORT, body="""SELECT study_id, doc_id, page, annot_idx, 'Annotator' AS author, text AS content, size::DOUBLE AS font_size, text_hex, '#00FFFF' AS fill_hex,
  abs(greatest(x1 - x0, line + 8) + 5 - (x1 - x0)) > 1 AS resized, round(x0, 4) AS x0, round(792 - y1, 4) AS y0, round(x0 + greatest(x1 - x0, line + 8) + 5, 4) AS x1, round(792 - y0, 4) AS y1 FROM exw""")
_EPOOL = "(SELECT * FROM ann WHERE type = 'FreeText')"
ORACLE["export_aligned_rows"] = _rec(ANN, _EXPORT, _fit_groups("h", "y0", 1, _EPOOL), _fit_groups("v", "x0", 10, _EPOOL), body=f"""SELECT study_id, e.doc_id, e.page, e.annot_idx, text AS content, text_hex,
  CASE WHEN {_F} AND NOT {_IS.format(0, 0, 0)} THEN text_hex <> {_DHEX} WHEN {_BLACKISH} THEN false ELSE text_hex <> {_DHEX} END AS recolored,
  true AS resized, round(CASE WHEN abs(x0 - v.mean) > 0.5 THEN v.mean ELSE x0 END, 4) AS x0, round(CASE WHEN abs(y0 - h.mean) > 0.5 THEN h.mean ELSE y0 END, 4) AS y0,
  round(CASE WHEN abs(x0 - v.mean) > 0.5 THEN v.mean ELSE x0 END + greatest(x1 - x0, line + 8) + 5, 4) AS x1, round(CASE WHEN abs(y0 - h.mean) > 0.5 THEN h.mean ELSE y0 END + (y1 - y0), 4) AS y1
  FROM exw e LEFT JOIN h ON h.doc_id = e.doc_id AND h.annot_idx = e.annot_idx LEFT JOIN v ON v.doc_id = e.doc_id AND v.annot_idx = e.annot_idx""")
_NUM = "CAST({} AS VARCHAR)"
_BODY = ('<contents-richtext><body xmlns="http://www.w3.org/1999/xhtml" xmlns:xfa="http://www.xfa.org/schema/xfa-data/1.0/" xfa:APIVersion="Acrobat:21.7.0" xfa:spec="2.0.2" style="font-size:')
_PLACED = f"""al AS (SELECT e.doc_id, e.page, e.annot_idx, text, e.size, text_hex, CASE WHEN abs(x0 - v.mean) > 0.5 THEN v.mean ELSE x0 END AS ax,
  CASE WHEN abs(y0 - h.mean) > 0.5 THEN h.mean ELSE y0 END AS ay, greatest(x1 - x0, line + 8) + 5 AS aw, y1 - y0 AS ah
  FROM exw e LEFT JOIN h ON h.doc_id = e.doc_id AND h.annot_idx = e.annot_idx LEFT JOIN v ON v.doc_id = e.doc_id AND v.annot_idx = e.annot_idx)"""
_RECT = " || ',' || ".join(f"CAST(round({c}, 4) AS VARCHAR)" for c in ("ax", "792 - (ay + ah)", "ax + aw", "792 - ay"))
ORACLE["export_lines"] = _rec(ANN, _EXPORT, _fit_groups("h", "y0", 1, _EPOOL), _fit_groups("v", "x0", 10, _EPOOL), _PLACED, body=f"""SELECT doc_id, page, annot_idx, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, page, annot_idx, unnest([1, 2, 3, 4, 5]) AS i, [
    '    <freetext color="#00FFFF" flags="print" page="' || (page - 1) || '" rect="' || {_RECT} || '" subject="VOID" title="Annotator">',
    {q('      ' + _BODY)} || size || 'pt;text-align:left;color:' || text_hex || ';font-weight:bold;font-style:italic;font-family:Arial;font-stretch:normal"><p dir="ltr">' || {_ESC.format('text')} || '</p></body></contents-richtext>',
    '      <defaultappearance>0 0 0 rg /Arial,BoldItalic ' || size || ' Tf</defaultappearance>',
    '      <defaultstyle>font: italic bold Arial,sans-serif ' || size || 'pt; text-align:left; color:#000000 </defaultstyle>', '    </freetext>'] AS ls FROM al)
  UNION ALL SELECT doc_id, 0, 0, i - 1, ls[i] FROM (SELECT doc_id, unnest([1, 2, 3, 4]) AS i, ['<?xml version="1.0" encoding="UTF-8"?>', '<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">', '  <f href="crf.pdf"/>', '  <annots>'] AS ls FROM (SELECT DISTINCT doc_id FROM exw))
  UNION ALL SELECT doc_id, last, 0, i - 1, ls[i] FROM (SELECT doc_id, max(page) + 1 AS last, unnest([1, 2]) AS i, ['  </annots>', '</xfdf>'] AS ls FROM exw GROUP BY doc_id)""")
_DA_COLOR = f"CASE WHEN {_F} THEN {_on_da(_standard('v3'))} ELSE '#000000' END"
_NOTE = "('Text', 'StrikeOut', 'Caret', 'Highlight', 'Underline')"
ORACLE["library_rows"] = with_(ANN, _need(*_STD), _resized("w + greatest(0, least(line + 8 - w, 200))", "h + greatest(0, least(size * 1.2 + 4 - h, 300))", "type = 'FreeText'", "AND NOT fits"), body=f"""SELECT study_id, doc_id, page, annot_idx,
  'Annotator' AS author, {_HEADER} AS is_header, {_CODE} AS domain, {_LABEL} AS label, checked, changed AS resized, CASE WHEN type = 'FreeText' THEN size END AS font_size, CASE WHEN type = 'FreeText' THEN 'hebi' END AS font_name,
  CASE WHEN type = 'FreeText' THEN {_DA_COLOR} END AS text, CASE WHEN type NOT IN {_NOTE} THEN '#00FFFF' END AS fill, CASE WHEN type NOT IN {_NOTE} THEN '#000000' END AS stroke,
  CASE WHEN type = 'Square' THEN 2.0::DOUBLE END AS border_width, CASE WHEN type = 'Square' THEN 'S' END AS border_style FROM rs""")
_CHANGED_COLOR = f"(CASE WHEN {_F} THEN {_on_da(_standard('v3'))} <> {_DHEX} ELSE false END)"
ORACLE["library_totals"] = _rec(ANN, _need(*_STD), _resized("w + greatest(0, least(line + 8 - w, 200))", "h + greatest(0, least(size * 1.2 + 4 - h, 300))", "type = 'FreeText'", "AND NOT fits"),
    _mean_groups("h", "y0", 1, "ann"), _mean_groups("v", "x0", 10, "ann"), body=f"""SELECT e.doc_id, count(*) AS annotations_modified, count({_CODE}) AS headers_found, count(*) FILTER (type = 'Square') AS rectangles_styled, count(*) FILTER (checked) AS textboxes_checked,
  count(*) FILTER (changed) AS textboxes_resized, count(*) FILTER (abs(y0 - h.mean) >= 0.5) AS annotations_aligned_horizontal, count(*) FILTER (abs(x0 - v.mean) >= 0.5) AS annotations_aligned_vertical,
  count(*) FILTER (type = 'FreeText' AND {_CHANGED_COLOR}) AS colors_standardized
  FROM rs e LEFT JOIN h ON h.doc_id = e.doc_id AND h.annot_idx = e.annot_idx LEFT JOIN v ON v.doc_id = e.doc_id AND v.annot_idx = e.annot_idx GROUP BY e.doc_id""")
ORACLE["preserved_rows"] = with_(ANN, _KEPT, body=f"""SELECT study_id, doc_id, page, annot_idx, CASE WHEN {_CODE} IS NOT NULL THEN content ELSE upper(content) END AS content, {_CODE} IS NOT NULL AS is_header, CASE WHEN {_CODE} IS NOT NULL THEN 12 ELSE 10 END AS font_size,
  color_name, {_HEX.format('r', 'g', 'b')} AS color FROM kept""")
_NEAR = " AND ".join(f"abs(e.{s} - k.{s}) < 5" for s in ("x0", "y0", "x1", "y1"))
ORACLE["color_workflow"] = with_(ANN, EXTRACT, _EXPORT, body=f"""SELECT doc_id, count(*) AS exported, count(*) FILTER (recolored) AS colors_standardized, count(*) AS imported FROM (SELECT doc_id,
  CASE WHEN {_F} AND NOT {_IS.format(0, 0, 0)} THEN text_hex <> {_DHEX} WHEN {_BLACKISH} THEN false ELSE text_hex <> {_DHEX} END AS recolored FROM exw e) GROUP BY doc_id""")
ORACLE["position_matches"] = with_(BOXES, body="""SELECT e.doc_id, e.page, e.annot_idx, min(k.annot_idx) AS match_idx FROM (SELECT doc_id, page, annot_idx, content, x0 + 3 AS x0, y0 - 2 AS y0 FROM bx) e
  LEFT JOIN bx k ON k.doc_id = e.doc_id AND k.page = e.page AND k.content = e.content AND abs(e.x0 - k.x0) < 5 AND abs(e.y0 - k.y0) < 5 GROUP BY ALL""")


# --- files -----------------------------------------------------------------

ORACLE["fdf_pages"] = """SELECT doc_id, pos, page, content FROM (SELECT 'U' || user_id AS doc_id, event_id AS pos, event_type, CAST(max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS page,
  event_type || ' of (' || value || ')' AS content FROM events) WHERE event_type = 'view' AND page IS NOT NULL"""
_SHEX0 = _HEX.format("r", "g", "b")
_LISTED = "printf('rgb(%d, %d, %d)', CAST(trunc(r * 255) AS INT), CAST(trunc(g * 255) AS INT), CAST(trunc(b * 255) AS INT))"
_ELS = f"""els AS (SELECT *, type <> 'Highlight' AS rich, trim(content) AS t, 'font-size:9.5pt;color:' || CASE WHEN type = 'Square' THEN {_LISTED} WHEN page = 1 THEN 'blue' ELSE {_SHEX0} END || ';font-weight:bold' AS style,
  trunc(r * 255) / 255 AS qr, trunc(g * 255) / 255 AS qg, trunc(b * 255) / 255 AS qb FROM ann)"""
ORACLE["xfdf_elements"] = with_(ANN, _ELS, body=f"""SELECT doc_id, page, annot_idx, coalesce(author, 'Annotator') AS author, CASE WHEN rich THEN {_SHEX0} ELSE '#00FFFF' END AS fill, {CLEAN.format('content')} AS content,
  CASE WHEN rich THEN 9.5::DOUBLE ELSE 10::DOUBLE END AS font_size, CASE WHEN rich AND type <> 'Square' AND page <> 1 THEN {_SHEX0} ELSE '#000000' END AS text_color, CASE WHEN page = 50 THEN 'invalid rect format' END AS error,
  CASE WHEN page <> 50 THEN round(x0, 4) END AS x0, CASE WHEN page <> 50 THEN round(y0, 4) END AS y0, CASE WHEN page <> 50 THEN round(x1, 4) END AS x1, CASE WHEN page <> 50 THEN round(y1, 4) END AS y1 FROM els""")
_QSTD = f"(SELECT {_standard('v3')} FROM (SELECT qr AS r, qg AS g, qb AS b))"
_UPDATED = f"""up AS (SELECT *, CASE WHEN rich AND (type = 'Square' OR page <> 1) THEN 'font-size:9.5pt;color:' || {_QSTD} || ';font-weight:bold' WHEN rich THEN style END AS new_style,
  CASE WHEN NOT rich THEN NULL WHEN (type = 'Square' OR page <> 1) AND {_QSTD} <> {_SHEX0} THEN 'standardized' ELSE 'unchanged' END AS outcome FROM els)"""
ORACLE["xfdf_color_update"] = with_(ANN, _ELS, _UPDATED, body="SELECT doc_id, annot_idx, new_style, outcome FROM up")
ORACLE["xfdf_color_totals"] = with_(ANN, _ELS, _UPDATED, body="""SELECT doc_id, count(outcome) AS annotations_processed, count(*) FILTER (outcome = 'standardized') AS colors_standardized,
  count(*) FILTER (outcome = 'unchanged') AS colors_unchanged FROM up GROUP BY doc_id""")
_RESTYLED = rf"""rt AS (SELECT *, CASE WHEN is_header THEN t ELSE upper(t) END AS new_text, CASE WHEN rich THEN 'font-size:' || CASE WHEN is_header THEN '12.0' ELSE '10.0' END || 'pt;text-align:left;color:' || CASE WHEN domain IN {_RED} THEN '#FF0000' ELSE '#0000FF' END ||
    ';font-weight:bold;font-style:italic;font-family:Arial;font-stretch:normal' END AS new_style, CASE WHEN rich THEN {_SHEX0} WHEN domain IS NULL THEN NULL WHEN domain IN {_RED} THEN '1.0 0.0 0.0' ELSE '0.0 0.0 1.0' END AS new_color,
    CASE WHEN author IS NOT NULL THEN 'Annotator' END AS new_title FROM (SELECT *, {_domain('t')} AS domain, regexp_matches(t, '^([A-Z]{{2}})\s*=\s*([^=]+)$') AS is_header FROM els))"""
ORACLE["xfdf_restyled"] = with_(ANN, _ELS, _RESTYLED, body="SELECT doc_id, annot_idx, domain, is_header, new_text, new_style, new_color, new_title FROM rt")
ORACLE["xfdf_restyle_totals"] = with_(ANN, _ELS, _RESTYLED, body=f"""SELECT doc_id, count(*) FILTER (rich) AS annotations_modified, count(*) FILTER (is_header) AS headers_found, count(*) FILTER (NOT is_header) AS text_capitalized,
  count(*) FILTER (rich AND coalesce(domain IN {_RED}, false)) AS red_annotations, count(*) FILTER (rich AND NOT coalesce(domain IN {_RED}, false)) AS blue_annotations, count(new_title) AS authors_changed FROM rt GROUP BY doc_id""")
ORACLE["xfdf_relinked"] = """SELECT page_id AS doc_id, true AS changed, '<xfdf>' || chr(10) || '<f href="crf$' || page_id || '.pdf"/>' || chr(10) || html || '  <f href="out.pdf"/>' || chr(10) || '</xfdf>' AS new_text FROM pages"""

# documents as files: names that studies share (``doc_id`` holds both here), coordinates to four places
_FILE_ANN = ANN.replace("ann AS (", "all_ann AS (") + """,
ann AS (SELECT * REPLACE (study_id || '/CRF-' || CAST(substr(doc_id, 5) AS BIGINT) // 5 AS doc_id, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1),
    l_linestatus = 'F' OR page = 45 AS rich, trunc(r * 255) / 255 AS qr, trunc(g * 255) / 255 AS qg, trunc(b * 255) / 255 AS qb
  FROM all_ann WHERE type = 'FreeText' AND """
_KEYS = "split_part(doc_id, '/', 1) AS study_id, split_part(doc_id, '/', 2) AS doc_id"
_USED = _FILE_ANN + "page < 46)"
ORACLE["xfdf_standardized"] = ORACLE["export_lines"].replace(ANN, _USED).replace(_EXPORT_COLOR, f"CASE WHEN rich THEN {_QSTD} ELSE '#000000' END")
_at = ORACLE["xfdf_standardized"].rindex("SELECT doc_id, page, annot_idx, i - 1 AS line_no")
ORACLE["xfdf_standardized"] = ORACLE["xfdf_standardized"][:_at] + f"""SELECT {_KEYS}, row_number() OVER (PARTITION BY doc_id ORDER BY page, annot_idx, line_no) - 1 AS line_no, line FROM ({ORACLE["xfdf_standardized"][_at:]})"""
ORACLE["xfdf_rejected"] = with_(_FILE_ANN + "page >= 46)", body=f"""SELECT {_KEYS}, ['broken element', 'missing content', 'invalid page', 'missing rect attribute', 'invalid rect format'][page - 45] AS error,
  count(*) AS n, count(*) FILTER (page = 46) AS texts FROM ann GROUP BY doc_id, page""")
ORACLE["xfdf_findings"] = checked(f"SELECT {_KEYS}, rule_no, message, count(*) AS n FROM f GROUP BY f.doc_id, rule_no, message").replace(ANN, _USED)
_BACK = rf"""els AS (SELECT *, CASE WHEN page <> 47 THEN trim(content) END AS txt, trim(content) AS t, {_SHEX0} AS hexed FROM ann),
back AS (
  SELECT 'recolored' AS job, *, CASE WHEN rich THEN hexed END AS color, trim(author) AS title, CASE WHEN page = 45 THEN 'font-size:9.5pt'
      WHEN rich THEN 'font-size:9.5pt;color:' || CASE WHEN page = 47 THEN hexed ELSE {_QSTD} END || ';font-weight:bold' END AS body_style, txt AS told FROM els
  UNION ALL
  SELECT 'restyled', * EXCLUDE (domain, is_header), CASE WHEN rich THEN hexed WHEN domain IS NULL THEN NULL WHEN domain IN {_RED} THEN '1.0 0.0 0.0' ELSE '0.0 0.0 1.0' END,
    CASE WHEN author IS NOT NULL THEN 'Annotator' END, CASE WHEN rich THEN 'font-size:' || CASE WHEN is_header THEN '12.0' ELSE '10.0' END || 'pt;text-align:left;color:' ||
      CASE WHEN domain IN {_RED} THEN '#FF0000' ELSE '#0000FF' END || ';font-weight:bold;font-style:italic;font-family:Arial;font-stretch:normal' END, CASE WHEN is_header THEN t ELSE upper(t) END
  FROM (SELECT *, CASE WHEN page NOT IN (45, 47) THEN {_domain('t')} END AS domain, coalesce(page NOT IN (45, 47) AND regexp_matches(t, '^([A-Z]{{2}})\s*=\s*([^=]+)$'), false) AS is_header FROM els))"""
ORACLE["xfdf_written_back"] = with_(_FILE_ANN + "page <> 46)", _BACK, body=f"""SELECT job, {_KEYS}, title, color, body_style,
  CASE WHEN rich AND page NOT IN (45, 47) THEN told END AS paragraph, CASE WHEN NOT rich AND page <> 47 THEN told END AS contents, CASE WHEN page = 45 THEN t END AS span, count(*) AS n
  FROM back GROUP BY ALL""")

ORACLE["folder_totals"] = with_(_FILE_ANN + "page <> 46)", """fl AS (SELECT *, CASE WHEN k % 4 = 2 THEN 'bad' WHEN k % 3 = 1 THEN 'empty' ELSE 'good' END AS state, page < 46 AS usable
  FROM (SELECT *, CAST(substr(split_part(doc_id, '/', 2), 5) AS BIGINT) AS k FROM ann)),
dl AS (SELECT doc_id, CASE WHEN state = 'good' AND NOT bool_or(usable) THEN 'empty' ELSE state END AS status, CASE WHEN state = 'good' THEN count(*) FILTER (usable) ELSE 0 END AS n FROM fl GROUP BY doc_id, state)""",
    body="""SELECT status, count(*) AS files, sum(n)::BIGINT AS elements FROM dl GROUP BY status
  UNION ALL SELECT ['missing content', 'invalid page', 'missing rect attribute', 'invalid rect format'][page - 46], count(DISTINCT doc_id), count(*) FROM fl WHERE state = 'good' AND NOT usable GROUP BY page""")
ORACLE["streamed_unused"] = parsed("SELECT domain FROM ds WHERE domain NOT IN (SELECT domain FROM ok WHERE domain IS NOT NULL)")


# --- settings --------------------------------------------------------------

def _settings(version: int = 1) -> str:
    n = f"(c_custkey * {version})"
    return f"""SELECT CAST(c_custkey AS VARCHAR) AS config_id, unnest([
    {{'key': 'validation.fuzzy_matching', 'kind': CASE WHEN {n} % 7 = 0 THEN 'str' ELSE 'bool' END, 'value': CASE WHEN {n} % 7 = 0 THEN '"yes"' ELSE 'true' END}},
    {{'key': 'validation.fuzzy_threshold', 'kind': CASE WHEN {n} % 5 = 0 THEN 'int' ELSE 'float' END, 'value': CASE WHEN {n} % 5 = 0 THEN '1' WHEN {n} % 3 = 0 THEN '1.5' ELSE '0.8' END}},
    {{'key': 'validation.ignore_domains', 'kind': 'list', 'value': CASE {n} % 4 WHEN 0 THEN '["ae", ""]' WHEN 1 THEN '["ae"]' ELSE '["DM", 3]' END}},
    {{'key': 'validation.ignore_variables', 'kind': 'list', 'value': CASE WHEN {n} % 6 = 0 THEN '["a b", "AGE_1", "x"]' ELSE '["STUDYID"]' END}},
    {{'key': 'validation.output_format', 'kind': 'str', 'value': CASE WHEN {n} % 8 = 0 THEN '"pdf"' ELSE '"csv"' END}},
    {{'key': 'validation.max_results', 'kind': CASE WHEN {n} % 9 = 0 THEN 'bool' ELSE 'int' END, 'value': CASE WHEN {n} % 9 = 0 THEN 'true' ELSE CAST({n} * 11 AS VARCHAR) END}},
    {{'key': 'paths.output_directory', 'kind': 'str', 'value': CASE WHEN {n} % 2 = 0 THEN '""' ELSE '"out/"' END}}], recursive := true) FROM customer"""


def _problem(test: str, key: str, message: str, severity: str = "error") -> str:
    return f"SELECT CAST(c_custkey AS VARCHAR) AS config_id, '{key}' AS key, '{severity}' AS severity, '{message}' AS message FROM customer WHERE {test}"


ORACLE["settings_problems"] = _all(
    _problem("c_custkey % 7 = 0", "fuzzy_matching", "Fuzzy Matching must be of type bool"),
    _problem("c_custkey % 5 = 0", "fuzzy_threshold", "Fuzzy Threshold must be of type float"),
    _problem("c_custkey % 5 <> 0 AND c_custkey % 3 = 0", "fuzzy_threshold", "Fuzzy Threshold must be less than or equal to 1.0"),
    _problem("c_custkey % 4 = 0", "ignore_domains", "Domain should be uppercase: ae", "warning"),
    _problem("c_custkey % 4 = 0", "ignore_domains", "Domain cannot be empty"),
    _problem("c_custkey % 4 > 1", "ignore_domains", "Domain must be a string, got int"),
    _problem("c_custkey % 6 = 0", "ignore_variables", "Variable should be uppercase: a b", "warning"),
    _problem("c_custkey % 6 = 0", "ignore_variables", "Variable contains invalid characters: a b"),
    _problem("c_custkey % 6 = 0", "ignore_variables", "Variable should be uppercase: x", "warning"),
    _problem("c_custkey % 8 = 0", "output_format", "Output Format must be one of: xlsx, csv, json"),
    _problem("true", "include_timestamp", "Missing required setting: Include Timestamp"),
    _problem("c_custkey % 9 <> 0 AND c_custkey * 11 > 10000", "max_results", "Max Results must be less than or equal to 10000"),
    _problem("c_custkey % 9 <> 0 AND c_custkey * 11 < 1", "max_results", "Max Results must be greater than or equal to 1"))
ORACLE["configuration_problems"] = f"""SELECT config_id, key, CASE WHEN key LIKE 'paths.%' THEN 'output_directory is required' WHEN key LIKE '%matching' THEN 'fuzzy_matching must be a boolean' ELSE 'fuzzy_threshold must be between 0 and 1' END AS message
  FROM ({_settings()}) WHERE (key LIKE 'paths.%' AND value = '""') OR (key LIKE '%fuzzy_matching' AND kind <> 'bool') OR (key LIKE '%fuzzy_threshold' AND value = '1.5')"""
ORACLE["settings_changes"] = f"""SELECT n.config_id, n.key, o.value AS old, n.value AS new FROM ({_settings(2)}) n LEFT JOIN ({_settings()}) o ON o.config_id = n.config_id AND o.key = n.key WHERE o.value IS DISTINCT FROM n.value"""
ORACLE["settings_defaults"] = f"""SELECT config_id, key, kind, CASE WHEN key LIKE '%fuzzy_threshold' AND value = '0.8' THEN '0.85' ELSE value END AS value FROM ({_settings()})
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'validation.align_annotations', 'bool', 'true' FROM customer"""


# --- audit and streams -----------------------------------------------------

_AUDIT = """au AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, event_type, 'user' || user_id AS "user", 'did ' || event_type AS action, props AS details, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status FROM events)"""
ORACLE["audit_filtered"] = with_(_AUDIT, body="""SELECT timestamp, event_type, "user", action, details, status FROM au WHERE timestamp >= '2024-01-02T00:00:00' AND timestamp <= '2024-01-20T23:59:59' AND status = 'success'""")
ORACLE["audit_retained"] = with_(_AUDIT, body="""SELECT timestamp[1:10] AS event_date, "user", count(*) AS n FROM au WHERE timestamp >= '2024-01-10T00:00:00' GROUP BY ALL""")
ORACLE["streamed_findings"] = checked("SELECT study_id, rule_no, severity, category, count(*) AS n FROM f GROUP BY ALL")
ORACLE["streamed_audit"] = with_(_AUDIT, body="""SELECT timestamp[1:10] AS event_date, "user", count(*) AS n FROM au WHERE status = 'failure' GROUP BY ALL""")


# --- late additions --------------------------------------------------------

_OWN_WORD = f"CASE WHEN {_F} THEN {_units('t', M.HELVETICA, 278)} * 10 / 1000.0 ELSE length(t) * 4.8 END"
_BLANK = f"CASE WHEN {_F} THEN 2.78 ELSE 4.8 END"
_ROWS = f"""wr AS (SELECT *, list_reduce(list_prepend({{'k': 0, 'o': -1.0::DOUBLE, 'wn': 0.0::DOUBLE}},
    list_transform(string_split(content, ' '), lambda t: {{'k': 0, 'o': 0.0::DOUBLE, 'wn': ({_OWN_WORD})::DOUBLE}})),
  lambda a, t: CASE WHEN a.o < 0 AND t.wn <= w - 8 THEN {{'k': a.k, 'o': t.wn, 'wn': 0.0::DOUBLE}} WHEN a.o < 0 THEN {{'k': a.k + 1, 'o': -1.0::DOUBLE, 'wn': 0.0::DOUBLE}}
    WHEN a.o + {_BLANK} + t.wn <= w - 8 THEN {{'k': a.k, 'o': a.o + {_BLANK} + t.wn, 'wn': 0.0::DOUBLE}} ELSE {{'k': a.k + 1, 'o': t.wn, 'wn': 0.0::DOUBLE}} END) AS z FROM nd),
rs AS (SELECT *, type = 'FreeText' AS checked, type = 'FreeText' AND NOT fits AND abs(nh - h) >= 1 AS changed FROM (SELECT *, w AS nw, h + least((z.k + (z.o >= 0)::INT) * (size * 1.2) + 4 - h, 300) AS nh FROM wr))"""
ORACLE["resized_height_only"] = with_(ANN, _need(*_OWN), _ROWS, body=_SIZES)
ORACLE["annotation_samples"] = with_(ANN, EXTRACT, body="""SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, annot_idx) AS place, page, annot_idx, content FROM ext) WHERE place <= 5""")


def _report_lines(source: str, section: int, page: str, first: str, idx: str, *texts: str) -> str:
    return f"""SELECT doc_id, {section} AS section, CAST({page} AS INT) AS page, CAST({first} AS BIGINT) AS first_idx, CAST({idx} AS BIGINT) AS annot_idx, i - 1 AS line_no, ls[i] AS line
  FROM (SELECT *, unnest(range(1, {len(texts) + 1})) AS i, [{', '.join(texts)}] AS ls FROM {source})"""


_BAR, _RULE = q("=" * 80), q("-" * 80)
_CODE4 = "lpad(CAST(CAST({} * 1000 AS INT) AS VARCHAR), 4, '0')"
ORACLE["color_report"] = with_(ANN, _KEPT, """dc AS (SELECT DISTINCT doc_id, color_name, r, g, b FROM kept), ct AS (SELECT doc_id, count(DISTINCT (r, g, b)) AS n FROM kept GROUP BY doc_id),
  pl AS (SELECT doc_id, page, color_name, min(annot_idx) AS f FROM kept GROUP BY ALL), im AS (SELECT *, min(annot_idx) OVER (PARTITION BY doc_id, page, color_name) AS f FROM kept)""", body=_all(
    _report_lines("ct", 0, "0", "0", "0", _BAR, "'PDF ANNOTATION COLOR USAGE REPORT'", _BAR, "''", "'Total Unique Colors: ' || n", "''", "'Unique Colors Found:'", _RULE),
    _report_lines("dc", 1, "0", " || ".join(_CODE4.format(c) for c in "rgb"), "0", "'  ' || color_name || ': RGB(' || r || ', ' || g || ', ' || b || ')'"),
    _report_lines("ct", 2, "0", "0", "0", "''", _BAR, "'COLOR USAGE BY PAGE'", _BAR, "''"),
    _report_lines("(SELECT DISTINCT doc_id, page FROM kept)", 3, "page", "-2", "-2", "''", "'Page ' || page || ':'", _RULE),
    _report_lines("pl", 3, "page", "f", "-1", "''", "'  ' || color_name || ':'"),
    _report_lines("im", 3, "page", "f", "annot_idx", "'    - ' || content")))
