"""DuckDB SQL with the rows of those queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

import string

#: Words: runs other than space and \t to \r.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

ORACLE = {
    "op1_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.format(LOWERED)} AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS sh FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p WHERE 100 * common >= 75 * (na + nb - common)
), both_ways AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM s
  UNION
  SELECT y.b, r.root FROM r JOIN both_ways y ON y.a = r.node WHERE r.root < y.b
), least AS (
  SELECT node, min(root) AS root FROM r GROUP BY 1
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, least.root AS component_id FROM s JOIN least ON least.node = s.doc_id
""",
    "op8_substring_dedup": f"""
WITH w AS (
  SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents
), v AS (
  SELECT doc_id, unnest(range(1, len(ws) - 18)) AS pos, ws FROM w WHERE len(ws) >= 20
), k AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(ws[pos:pos + 19], ' ') ORDER BY doc_id, pos) AS nth FROM v
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS place FROM k WHERE nth > 1
), word AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS place, unnest(ws) AS word FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS t
  FROM word ANTI JOIN gone USING (doc_id, place) GROUP BY 1
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
}
