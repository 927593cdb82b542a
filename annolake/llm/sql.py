"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from annolake.llm import chat, licenses

_PARTS = r"""
  SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0
               THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)
"""
URL_FILTER = f"""
WITH p AS ({_PARTS}),
rules(rh, rp, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls AS (SELECT DISTINCT host, path FROM p),
best AS (SELECT host, path, max_by(rh || rp, length(rh || rp)) AS rule,
                max_by(verdict, length(rh || rp)) AS verdict
         FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
         GROUP BY host, path),
listed AS (SELECT host, path FROM p WHERE host <> '' GROUP BY host, path HAVING count(*) > 1)
SELECT page_id, p.host, p.path, rule,
       coalesce(verdict, CASE WHEN listed.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (host, path) LEFT JOIN listed USING (host, path)
"""
CHAT_FORMAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
         length(regexp_replace(role, '{chat.CONTROL}', '\1\\\2\3', 'g')) AS role_chars,
         length(regexp_replace(text, '{chat.CONTROL}', '\1\\\2\3', 'g')) AS text_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN before = role THEN {len(chat.NEXT)}
                             ELSE {len(chat.OPEN) + len(chat.SEP)} + role_chars END
           + CASE WHEN after = role THEN 0 ELSE {len(chat.CLOSE)} END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
LM_SCORING = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS w, unnest(list_concat([' '], words[:-2])) AS u FROM docs WHERE len(words) > 0),
ones AS (SELECT w, count(*) AS n FROM placed GROUP BY w),
marks AS (SELECT w, n FROM ones UNION ALL SELECT ' ', count(*) FROM docs WHERE len(words) > 0),
twos AS (SELECT u, w, count(*) AS n FROM placed GROUP BY u, w),
scored AS (
  SELECT doc_id, CASE WHEN twos.n >= 2 THEN ln(twos.n) - ln(marks.n)
                      ELSE ln(0.4) + ln(ones.n) - ln((SELECT sum(n) FROM ones)) END AS s
  FROM placed JOIN twos USING (u, w) JOIN ones ON ones.w = placed.w JOIN marks ON marks.w = placed.u)
SELECT docs.doc_id, count(s) AS n_words, round(coalesce(sum(s), 0), 4) AS log_score
FROM docs LEFT JOIN scored ON scored.doc_id = docs.doc_id GROUP BY docs.doc_id
"""
#: CRC-32 of an ASCII text, by a table of its 256 one-byte remainders.
_CRC = """(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""


def _way(name: str, more: int | str, edit: str) -> str:
    return f"{{'c': {name}.c + {more}, 'a': {name}.a || '{edit}'}}"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


STRUCTURE_REPAIR = f"""
WITH RECURSIVE crc AS {_CRC},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]))) % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
  FROM damaged),
rows AS (
  SELECT *, role[1] AS head, CASE WHEN shown = '' THEN 'blank'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
            WHEN shown[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
ways AS (
  SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': ''}} AS empty, {{'c': 1000000000::BIGINT, 'a': ''}} AS sys,
         {{'c': 1000000000::BIGINT, 'a': ''}} AS usr, {{'c': 1000000000::BIGINT, 'a': ''}} AS asst
  FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL
  SELECT conv_id, k, {_way('empty', 3, 'D')},
         CASE WHEN head = 's' AND NOT must THEN {_least(_way('sys', 3, 'D'), _way('empty', 'late', 'K'))} ELSE {_way('sys', 3, 'D')} END,
         CASE WHEN must THEN {_way('u', 3, 'D')} WHEN head = 'u' THEN {_least(_way('u', 3, 'D'), *(_way(w, 'late', 'K') for w in ('empty', 'sys', 's')))}
              ELSE {_least(_way('u', 3, 'D'), *(_way(w, '2 + late', 'R') for w in ('empty', 'sys', 's')))} END,
         CASE WHEN must THEN {_way('s', 3, 'D')} WHEN head = 'a' THEN {_least(_way('s', 3, 'D'), _way('u', 'late', 'K'))}
              ELSE {_least(_way('s', 3, 'D'), _way('u', '2 + late', 'R'))} END
  FROM (SELECT w.conv_id, rows.k, empty, sys, u, {_least('asst', _way('u', 2, 'I'))} AS s, head,
               fault IN ('blank', 'duplicate') AS must, (fault = 'truncated')::BIGINT AS late
        FROM (SELECT *, {_least('usr', *(_way(w, 2, 'I') for w in ('empty', 'sys', 'asst')))} AS u FROM ways) AS w
        JOIN rows ON rows.conv_id IS NOT DISTINCT FROM w.conv_id AND rows.k = w.k + 1)),
ended AS (
  SELECT conv_id, k, {_least('empty', 'asst', _way('u', 2, 'I'))} AS best
  FROM (SELECT *, {_least('usr', *(_way(w, 2, 'I') for w in ('empty', 'sys', 'asst')))} AS u FROM ways)),
final AS (SELECT conv_id, best.c AS cost, best.a AS audit FROM ended JOIN (SELECT conv_id, max(k) AS k FROM rows GROUP BY conv_id) USING (conv_id, k)),
edits AS (
  SELECT conv_id, i, audit[i] AS edit,
         length(replace(audit[:i], 'I', '')) AS k
  FROM final, range(1, length(audit) + 1) AS r(i)),
told AS (
  SELECT e.conv_id, i, edit, rows.role, rows.text,
         sum((edit <> 'D')::INT) OVER (PARTITION BY e.conv_id ORDER BY i) AS nth,
         first_value(CASE WHEN edit = 'K' AND head = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id, edit <> 'D' ORDER BY i) AS opens
  FROM edits e LEFT JOIN rows ON edit <> 'I' AND rows.conv_id = e.conv_id AND rows.k = e.k),
mended AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - opens) % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS lines
  FROM told WHERE edit <> 'D' GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (k > 1 AND before || head NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN final USING (conv_id)
LEFT JOIN mended USING (conv_id)
"""
_NOTICES = [licenses.template(*t) for t in licenses.TEMPLATES]
LICENSE_SCAN = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM docs),
follow AS (SELECT *, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
base AS (
  SELECT doc_id, i, CASE WHEN w = 'cc' THEN 'cc-by' WHEN w = 'general' THEN 'gpl' ELSE 'reserved' END AS label FROM follow
  WHERE (w = 'cc' AND w2 = 'by') OR (w = 'general' AND w2 = 'public' AND w3 = 'license')
     OR (w = 'all' AND w2 = 'rights' AND w3 = 'reserved')),
notices(t, label, place, w, is_key, size, need, keys) AS (VALUES
  {", ".join(f"({n}, '{t.label}', {i}, '{w}', {i in t.keys}, {len(t.words)}, {t.need}, {len(t.keys)})"
             for n, t in enumerate(_NOTICES) for i, w in enumerate(t.words))}),
found AS (
  SELECT doc_id, label, count(*) / size AS share FROM placed JOIN notices USING (w)
  GROUP BY doc_id, t, label, i - place, size, need, keys HAVING count(*) >= need AND count(*) FILTER (is_key) = keys),
told AS (SELECT doc_id, label, 1.0::DOUBLE AS share FROM base UNION ALL SELECT * FROM found)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs
LEFT JOIN (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
                  string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
           FROM told GROUP BY doc_id) USING (doc_id)
"""
ORACLE = {"op11_license_scan": LICENSE_SCAN, "op12_structure_repair": STRUCTURE_REPAIR, "op1_url_filter": URL_FILTER, "op2_chat_format": CHAT_FORMAT, "op6_lm_scoring": LM_SCORING}
