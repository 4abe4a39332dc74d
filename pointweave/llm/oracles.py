"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from pointweave.llm import jaccard, quality_rules

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sets of shingles, links by counting shared ones, components by reachability.
JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= {jaccard.N} THEN list_distinct(list_transform(range(1, len(ws) - {jaccard.N} + 2), lambda i: array_to_string(ws[i : i + {jaccard.N - 1}], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS tokens FROM w),
x AS (SELECT doc_id, len(tokens) AS n, unnest(tokens) AS token FROM s),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= {jaccard.PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
reached AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reached r JOIN link l ON r.b = l.a)
SELECT s.doc_id, CAST(len(tokens) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY 1) c ON c.a = s.doc_id
"""

_Q = quality_rules
#: Measures by whole texts, host counts, a beta prior from the hosts' spread, and the verdicts.
QUALITY_RULES = f"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - {_Q.WINDOW} + 2)) AS i, array_to_string(ws[i : i + {_Q.WINDOW - 1}], ' ') AS v FROM t),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM win), range(0, {_Q.WINDOW}) r(k) WHERE c > 1 GROUP BY 1),
m AS (
  SELECT t.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{_Q.SYMBOLS}', '')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id),
q AS (SELECT * EXCLUDE (lines), CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
r AS (
  SELECT *, CAST(n_symbols > CAST({_Q.SOFT_SYMBOLS_PER_WORD} AS DOUBLE) * n_words AS INTEGER) + CAST(n_dup_lines > CAST({_Q.SOFT_DUP_LINES} AS DOUBLE) * n_lines AS INTEGER)
    + CAST(word_chars / CAST(greatest(n_words, 1) AS DOUBLE) NOT BETWEEN CAST({_Q.SOFT_WORD_CHARS[0]} AS DOUBLE) AND CAST({_Q.SOFT_WORD_CHARS[1]} AS DOUBLE) AS INTEGER) AS soft FROM q),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed OR soft > 0) AS DOUBLE) AS failed FROM r GROUP BY 1),
g AS (SELECT sum(n) AS n, least(greatest(sum(failed) / sum(n), 1e-6), CAST(1 AS DOUBLE) - 1e-6) AS m, sum(failed * failed / n) AS sq, count(*) AS k FROM h),
p AS (SELECT m, least(greatest(m * (1 - m) / greatest((sq / n - m * m) - m * (1 - m) * k / n, 1e-9) - 1, 2e0), 1e4) AS strength FROM g),
rate AS (SELECT host, (failed + m * strength) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false WHEN rate >= CAST({_Q.BLOCKED} AS DOUBLE) THEN false WHEN rate < CAST({_Q.TRUSTED} AS DOUBLE) THEN soft < 2 ELSE soft = 0 END AS kept, round(rate, 6) AS host_rate
FROM r JOIN rate ON rate.host IS NOT DISTINCT FROM r.host
"""

SQL = {"op2_ngram_jaccard_join": JACCARD, "op6_quality_rules": QUALITY_RULES}
