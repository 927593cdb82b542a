"""The registered queries in DuckDB SQL, built from shared table expressions."""

from __future__ import annotations

from annolake.functions import metrics as M
from annolake.functions import text as X
from annolake.operators import patterns as P
from annolake.schemas import PARSED_FIELDS
from annolake.workload import feeds as W


def q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, number: str) -> str:
    return f"({arr(values)})[CAST(({number}) % {len(values)} + 1 AS BIGINT)]"


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- feeds -----------------------------------------------------------------

def _line_text() -> str:
    text = pick(W.TEMPLATES, "l_orderkey * 7 + l_linenumber + l_partkey")
    for mark, value in (("{v}", pick(W.NAMES, "l_orderkey + l_partkey")),
                        ("{w}", pick(W.NAMES, "l_partkey * 3 + 1")),
                        ("{d}", pick(W.DOMAINS, "l_orderkey + l_linenumber")),
                        ("{l}", pick(W.LABELS, "l_partkey + l_linenumber")),
                        ("{n}", "CAST(CAST(l_quantity AS INT) AS VARCHAR)")):
        text = f"replace({text}, {q(mark)}, {value})"
    return text


_D4 = "CAST(CAST({} AS DECIMAL(6,4)) AS VARCHAR)"
ANN = f"""ann0 AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
    'ST' || CAST(l_suppkey % 5 AS VARCHAR) AS study_id, 'CRF-' || CAST(l_suppkey AS VARCHAR) AS doc_id,
    CAST(l_partkey % 50 + 1 AS INT) AS page,
    (l_orderkey * 10 + l_linenumber) * 50000 + (l_partkey // 50) % 1000 * 50 + CAST(l_quantity AS INT) - 1 AS annot_idx,
    {pick(("FreeText", "FreeText", "FreeText", "Square", "FreeText", "Highlight", "FreeText"), "l_linenumber + l_partkey")} AS type,
    CASE WHEN l_returnflag = 'R' THEN ' ' WHEN l_returnflag = 'A' THEN 'Coder' END AS author,
    {_line_text()} AS content,
    (l_partkey * 17) % 500 + l_discount * 100 AS x0, (l_orderkey * 37) % 700 + l_tax * 100 AS y0,
    l_discount * 10 AS r, least(l_tax * 12, 1.0) AS g, l_quantity / 50 AS b
  FROM lineitem),
ann AS (
  SELECT *, x0 + (l_quantity * 4 + 10) AS x1, y0 + (l_linenumber * 4 + 6) AS y1,
    CASE WHEN l_linestatus = 'F' THEN '/Helv 10 Tf ' || {_D4.format('r')} || ' ' || {_D4.format('g')} || ' ' || {_D4.format('b')} || ' rg'
      ELSE '/Cour 8 Tf 0 0 0 rg' END AS da,
    CAST({_D4.format('r')} AS DOUBLE) AS dr, CAST({_D4.format('g')} AS DOUBLE) AS dg, CAST({_D4.format('b')} AS DOUBLE) AS db
  FROM ann0)"""

CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
EXTRACT = f"""ext AS (
  SELECT study_id, doc_id, page, annot_idx, author, type, {CLEAN.format('content')} AS content, x0, y0, x1, y1
  FROM ann WHERE {CLEAN.format('content')} <> '')"""

_number = "event_id + user_id"
EVENT_PAGES = """pg AS (
  SELECT 'U' || CAST(user_id AS VARCHAR) AS doc_id, CAST(event_id + 1 AS INT) AS page, event_type, value,
    upper(event_type[1:1]) || event_type[2:] AS title
  FROM events)"""
EVENT_ANN = f"""ea AS (
  SELECT 'U' || CAST(user_id AS VARCHAR) AS doc_id, CAST(event_id + 1 AS INT) AS page, event_id AS annot_idx,
    event_type, value, {pick(("DM", "AE", "VS", "LB", "CM"), _number)} AS dom,
    CASE WHEN value < 20 THEN {pick(("DM", "AE", "VS", "LB", "CM"), _number)} || ' = ' || upper(event_type[1:1]) || event_type[2:]
      WHEN value < 40 THEN {pick(("DM", "AE", "VS", "LB", "CM"), _number)} || '=' || upper(event_type) || ' DATA'
      ELSE {pick(("DM", "AE", "VS", "LB", "CM"), _number)} || 'TERM of the ' || event_type || ' case numbered ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS content
  FROM events)"""
BOXES = """bx AS (
  SELECT 'U' || CAST(user_id AS VARCHAR) AS doc_id, CAST(event_id % 20 + 1 AS INT) AS page, event_id AS annot_idx,
    CASE WHEN event_type = 'error' THEN 'Square' ELSE 'FreeText' END AS type,
    'Annotation of the ' || event_type || ' event' AS content,
    round_even(value, 0) AS x0, (event_id * 37) % 700 + (event_id % 8) / 4.0 AS y0
  FROM events)"""


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(
        str(v) if isinstance(v, int) else q(v) for v in row) + ")" for row in rows)


CATALOG = f"""ds(domain, label) AS ({values(W.DATASETS)}),
vars(domain, ordinal, name) AS ({values([(d, i, n) for d, ns in W.COLUMNS.items() for i, n in enumerate(ns, 1)])}),
supp(domain, name) AS ({values([("SUPPDM", n) for n in W.QNAMS])}),
links(name) AS ({values([(n,) for n in W.IDVARS])})"""


# --- parsing ---------------------------------------------------------------

def winner(patterns, text: str = "text", flags: str = "'i'") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(p.regex)}, {flags}) THEN {i}"
                              for i, p in enumerate(patterns, 1)) + " END"


def field(name: str, patterns) -> str:
    hits = [f"WHEN {i} THEN regexp_extract(text, {q(p.regex)}, {p.fields[name]}, 'i')"
            for i, p in enumerate(patterns, 1) if name in p.fields]
    return f"nullif(CASE win {' '.join(hits)} END, '')" if hits else "CAST(NULL AS VARCHAR)"


def parse_ctes(dialect: str = "config", source: str = "ext", patterns=None, dm=W.COLUMNS["DM"]) -> str:
    """CTE ``parsed``: every produced row with ``reason`` (null when accepted)."""
    builtin = dialect == "builtin"
    patterns = patterns or ([P.builtin_view(p) for p in P.BUILTIN_PATTERNS] if builtin else list(P.DEFAULT_PATTERNS))
    comments = [i for i, p in enumerate(patterns, 1)
                if (p.name in P.BUILTIN_COMMENTS if builtin else p.is_comment)]
    names = " ".join(f"WHEN {i} THEN {q(p.name)}" for i, p in enumerate(patterns, 1))
    dm = ", ".join(q(n) for n in dm) or "NULL"
    parts = """CASE WHEN variables IS NOT NULL
        THEN list_filter(list_transform(string_split_regex(variables, '[,/]'), lambda v: {'v': trim(v), 'val': value, 'c': condition}), lambda s: s.v <> '')"""
    if builtin:
        parts += """
        WHEN pattern_type = 'DOMAIN_WHEN_CONDITION' AND len(string_split(condition, '=')) = 2 THEN
          [{'v': nullif(trim(string_split(condition, '=')[1]), ''), 'val': nullif(trim(string_split(condition, '=')[2]), ''), 'c': NULL},
           {'v': nullif(trim(string_split(condition, '=')[2]), ''), 'val': nullif(trim(string_split(condition, '=')[1]), ''), 'c': NULL}]
        WHEN pattern_type = 'DOMAIN_WHEN_CONDITION' THEN [{'v': 'IDVAR', 'val': value, 'c': condition}]"""
    parts += "\n        ELSE [{'v': variable_name, 'val': value, 'c': coalesce(tc || ' = ' || tv, condition)}] END"
    return f"""won AS (SELECT *, content AS text, {winner(patterns, 'content')} AS win FROM {source}),
fields AS (SELECT * EXCLUDE (win), win, CASE win {names} END AS pattern_type,
    coalesce(win IN ({', '.join(map(str, comments))}), false) AS is_comment,
    {", ".join(f"{field(f, patterns)} AS {n}" for f, n in (('domain', 'domain0'), ('variable_name', 'variable_name'), ('value', 'value'), ('condition', 'condition'), ('label', 'label'), ('test_cd_variable', 'tc'), ('test_cd_value', 'tv'), ('variable_name_end', 'variable_name_end'), ('variables', 'variables')))}
  FROM won),
exploded AS (SELECT * EXCLUDE (variable_name, value, condition), unnest(p) AS s, generate_subscripts(p, 1) - 1 AS part_idx
  FROM (SELECT *, {parts} AS p FROM fields)),
parsed0 AS (SELECT study_id, doc_id, page, annot_idx, x0, y0, text, part_idx, pattern_type, is_comment,
    coalesce(domain0, CASE WHEN length(s.v) < 2 THEN NULL WHEN s.v IN ({dm}) THEN 'DM' ELSE upper(s.v[1:2]) END) AS domain,
    s.v AS variable_name, s.val AS value, s.c AS condition, label,
    {"CAST(NULL AS VARCHAR)" if builtin else "tc"} AS test_cd_variable,
    {"CAST(NULL AS VARCHAR)" if builtin else "tv"} AS test_cd_value, variable_name_end FROM exploded),
parsed AS (SELECT *, CASE WHEN pattern_type IS NULL OR is_comment OR (label IS NOT NULL AND domain IS NOT NULL AND variable_name IS NULL) THEN NULL
    WHEN domain IS NULL THEN 'no domain' WHEN variable_name IS NULL AND label IS NULL THEN 'no variable'
    WHEN NOT regexp_matches(domain, '^([A-Z]{{2,6}}|SUPP[A-Z]{{2,}})$') THEN 'invalid domain name'
    WHEN NOT regexp_matches(variable_name, '^[A-Z0-9_]+$') THEN 'invalid variable name' END AS reason FROM parsed0),
ok AS (SELECT * EXCLUDE (reason) FROM parsed WHERE reason IS NULL)"""


# --- findings --------------------------------------------------------------

FINDINGS = """gated AS (SELECT *, domain AS seen_domain FROM ok),
moved AS (SELECT * REPLACE (CASE WHEN pattern_type IS NOT NULL AND variable_name IN (SELECT name FROM vars WHERE domain = 'DM') THEN 'DM' ELSE domain END AS domain) FROM gated),
facts AS (SELECT m.*, d.domain IS NOT NULL AS ex, d.label AS known_label,
    EXISTS (SELECT 1 FROM vars v WHERE v.domain = m.domain AND v.name = m.variable_name) AS has_col,
    EXISTS (SELECT 1 FROM vars v WHERE v.domain = m.domain AND v.name = 'QNAM') AS has_qnam,
    EXISTS (SELECT 1 FROM vars v WHERE v.domain = m.domain AND v.name = 'IDVAR') AS has_idvar,
    EXISTS (SELECT 1 FROM supp s WHERE s.domain = m.domain AND s.name = m.variable_name) AS has_supp
  FROM moved m LEFT JOIN ds d ON d.domain = CASE WHEN m.label IS NOT NULL AND m.variable_name IS NULL THEN upper(m.domain) ELSE m.domain END),
live AS (SELECT * FROM facts WHERE pattern_type IS NOT NULL),
vrows AS (SELECT * FROM live WHERE NOT is_comment AND ex AND variable_name IS NOT NULL),
base AS (
  SELECT *, 1 AS rule_no, 0 AS token_no, 'INFO' AS severity, 'Pattern Match' AS category, 'Annotation did not match any known pattern' AS message, 'Update configuration file with appropriate pattern' AS suggested_correction FROM facts WHERE pattern_type IS NULL
  UNION ALL SELECT *, 2, 0, 'ERROR', 'Wrong Domain', 'Domain ''' || domain || ''' not found in SDTM datasets.', NULL FROM live WHERE label IS NOT NULL AND domain IS NOT NULL AND NOT ex
  UNION ALL SELECT *, 3, 0, 'ERROR', 'Metadata Mismatch', 'Mismatched dataset label for domain ''' || domain || '''. Expected ''' || known_label || ''', but found ''' || label || ''' in annotation.', NULL FROM live WHERE label IS NOT NULL AND ex AND known_label IS NOT NULL AND lower(trim(label)) <> lower(trim(known_label))
  UNION ALL SELECT *, 4, 0, 'WARNING', 'Metadata Mismatch', 'Dataset label for domain ''' || domain || ''' not found in the dataset file.', NULL FROM live WHERE label IS NOT NULL AND ex AND known_label IS NULL
  UNION ALL SELECT *, 6, 0, 'ERROR', 'Missing Variable', 'Variable ''' || variable_name || ''' not found in ' || domain, NULL FROM vrows WHERE domain NOT LIKE 'SUPP%' AND NOT has_col AND variable_name NOT IN ('STUDYID', 'USUBJID')
  UNION ALL SELECT *, 7, 0, 'ERROR', 'Missing Variable', 'Domain ' || domain || ' is a SUPP domain but does not contain QNAM variable.', NULL FROM vrows WHERE domain LIKE 'SUPP%' AND NOT has_qnam AND upper(variable_name) NOT IN ('STUDYID', 'USUBJID')
  UNION ALL SELECT *, 8, 0, 'ERROR', 'Missing Variable', 'Variable ''' || variable_name || ''' not found in QNAM of ' || domain || '.', NULL FROM vrows WHERE domain LIKE 'SUPP%' AND has_qnam AND NOT has_supp AND upper(variable_name) NOT IN ('STUDYID', 'USUBJID')
  UNION ALL SELECT * EXCLUDE (tok, tno), 10, tno, 'ERROR', 'Missing Variable', 'Variable ''' || tok || ''' from condition not found in IDVAR of ' || domain || '.', NULL
    FROM (SELECT *, unnest(regexp_extract_all(condition, '([A-Z0-9_]+)')) AS tok, generate_subscripts(regexp_extract_all(condition, '([A-Z0-9_]+)'), 1) - 1 AS tno FROM live WHERE NOT is_comment AND domain = 'RELREC' AND ex AND condition IS NOT NULL)
    WHERE tok NOT IN (SELECT name FROM links)
  UNION ALL SELECT *, 11, 0, 'ERROR', 'Incorrect Value', 'Conditional check failed for PFORRES: PFTESTCD is not CYTABNRM, but ' || trim(string_split(condition, '=')[2]), NULL FROM live WHERE NOT is_comment AND domain = 'PF' AND variable_name = 'PFORRES' AND len(string_split(condition, '=')) = 2 AND trim(string_split(condition, '=')[1]) = 'PFTESTCD' AND trim(string_split(condition, '=')[2]) <> 'CYTABNRM'),
f AS (SELECT study_id, doc_id, page, annot_idx, part_idx, x0, y0, text, domain, variable_name, value, condition, label, pattern_type, rule_no, token_no, severity, category, message, suggested_correction FROM base)"""

# misspelt names: the longest common block of two names, then of what is left and right of it
_MISSED = "domain NOT LIKE 'SUPP%' AND NOT has_col AND variable_name NOT IN ('STUDYID', 'USUBJID')"
_INSIDE = "i >= al AND i + k <= ah AND j >= bl AND j + k <= bh"
SIMILAR = f"""miss AS (SELECT DISTINCT domain AS md, variable_name AS mv FROM vrows WHERE {_MISSED}),
pairs AS (SELECT md, mv, name, ordinal, lower(mv) AS a, lower(name) AS b FROM miss JOIN vars ON domain = md),
blocks AS (SELECT md, mv, name, i, j, k FROM pairs, range(length(a)) AS x(i), range(length(b)) AS y(j), range(1, least(length(a) - i, length(b) - j) + 1) AS z(k)
  WHERE a[i + 1:i + k] = b[j + 1:j + k]),
spans AS (SELECT md, mv, name, 0::BIGINT AS al, length(a) AS ah, 0::BIGINT AS bl, length(b) AS bh FROM pairs
  UNION ALL SELECT md, mv, name, CASE WHEN side = 0 THEN al ELSE best.i + best.k END, CASE WHEN side = 0 THEN best.i ELSE ah END,
    CASE WHEN side = 0 THEN bl ELSE best.j + best.k END, CASE WHEN side = 0 THEN best.j ELSE bh END
  FROM (SELECT md, mv, name, al, ah, bl, bh, arg_max({{'i': i, 'j': j, 'k': k}}, (k, -i, -j)) AS best FROM spans JOIN blocks USING (md, mv, name)
    WHERE {_INSIDE} GROUP BY md, mv, name, al, ah, bl, bh) AS cut, range(2) AS s(side)),
common AS (SELECT md, mv, name, sum(k) AS m FROM (SELECT md, mv, name, al, bl, max(k) AS k FROM spans JOIN blocks USING (md, mv, name) WHERE {_INSIDE}
  GROUP BY md, mv, name, al, ah, bl, bh) GROUP BY md, mv, name),
hit AS (SELECT md, mv, arg_max(name, (ratio, -ordinal)) AS near, max(ratio) AS ratio FROM (SELECT *, 2.0 * m / (length(a) + length(b)) AS ratio FROM pairs JOIN common USING (md, mv, name))
  WHERE ratio >= 0.85 GROUP BY md, mv)"""
_EXACT = f"UNION ALL SELECT *, 6, 0, 'ERROR', 'Missing Variable', 'Variable ''' || variable_name || ''' not found in ' || domain, NULL FROM vrows WHERE {_MISSED}"
_NEAR = f"""UNION ALL SELECT vrows.*, CASE WHEN near IS NULL THEN 6 ELSE 5 END, 0, CASE WHEN near IS NULL THEN 'ERROR' ELSE 'WARNING' END,
    CASE WHEN near IS NULL THEN 'Missing Variable' ELSE 'Typo in Variable Name' END, 'Variable ''' || variable_name || ''' not found in ' || domain ||
    CASE WHEN near IS NULL THEN '' ELSE ', but similar to ''' || near || ''' (similarity: ' || printf('%.2f', ratio) || ')' END, NULL
    FROM vrows LEFT JOIN hit ON md = domain AND mv = variable_name WHERE {_MISSED}"""
assert _EXACT in FINDINGS
FINDINGS_SIMILAR = FINDINGS.replace("base AS (", SIMILAR + ",\nbase AS (").replace(_EXACT, _NEAR)


def checked(body: str, similar: bool = False) -> str:
    """SQL over the findings; with ``similar`` misspelt names are told."""
    if similar:
        return with_(ANN, EXTRACT, CATALOG, parse_ctes(), FINDINGS_SIMILAR, body=body).replace("WITH ", "WITH RECURSIVE ", 1)
    return with_(ANN, EXTRACT, CATALOG, parse_ctes(), FINDINGS, body=body)


def parsed(body: str, dialect: str = "config") -> str:
    return with_(ANN, EXTRACT, CATALOG, parse_ctes(dialect), body=body)
