"""SQL of the corpus queries that SQL can express; the others are tested against brute force in ``tests/llm``."""

from __future__ import annotations

from graphloop.llm import line_dedup

#: First occurrences by the normalised unit itself; runs of repeated sentences and spans that touch are islands.
OP6 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS unit,
         generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) AS l
  FROM documents
), sentences AS (
  SELECT doc_id, l, unnest(regexp_extract_all(unit, '[^.!?\n]*[.!?]+\n?|[^.!?\n]+\n?|\n')) AS unit,
         generate_subscripts(regexp_extract_all(unit, '[^.!?\n]*[.!?]+\n?|[^.!?\n]+\n?|\n'), 1) AS k
  FROM lines
), pieces AS (
  SELECT true AS line, doc_id, l AS k, unit, CAST(coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM lines
  UNION ALL
  SELECT false, doc_id, NULL, unit, CAST(coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY l, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) FROM sentences
), placed AS (
  SELECT *, s + length(unit) AS e, trim(regexp_replace(lower(unit), '\s+', ' ', 'g')) AS norm FROM pieces
), worded AS (
  SELECT *, len(string_split(norm, ' ')) AS words, row_number() OVER (PARTITION BY line, doc_id ORDER BY s) AS place FROM placed WHERE norm <> ''
), ranked AS (
  SELECT *, row_number() OVER w AS r, first_value(doc_id) OVER w AS first_id FROM worded WINDOW w AS (PARTITION BY line, norm ORDER BY doc_id, s)
), again AS (
  SELECT *, place - row_number() OVER (PARTITION BY line, doc_id ORDER BY place) AS run FROM ranked WHERE r > 1
), lost AS (
  SELECT * FROM (SELECT *, sum(words) OVER (PARTITION BY line, doc_id, run) AS run_words FROM again) WHERE line OR run_words >= {line_dedup.PASSAGE}
), edges AS (
  SELECT *, CASE WHEN max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS starts FROM lost
), islands AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM edges),
spans AS (SELECT doc_id, island, min(s) AS s, max(e) AS e, CAST(count(*) AS BIGINT) AS n FROM islands GROUP BY ALL),
used AS (SELECT a.doc_id, list_sort(list_distinct(list(a.first_id))) AS first_ids FROM again a JOIN spans p ON a.doc_id = p.doc_id AND a.s >= p.s AND a.e <= p.e GROUP BY a.doc_id),
gone AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_units, CAST(sum(e - s) AS BIGINT) AS n_chars, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, island, e AS s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM spans
  UNION ALL SELECT doc_id, 0, 0, min(s) FROM spans GROUP BY doc_id
), parts AS (
  SELECT k.doc_id, string_agg(substr(d.text, CAST(k.s AS BIGINT) + 1, CAST(coalesce(k.e, length(d.text)) - k.s AS BIGINT)), '' ORDER BY k.s) AS text FROM kept k JOIN documents d USING (doc_id) GROUP BY k.doc_id
)
SELECT d.doc_id, coalesce(p.text, d.text) AS text, coalesce(g.n_units, 0) AS n_units, coalesce(g.n_chars, 0) AS n_chars, coalesce(g.spans, '') AS spans, coalesce(u.first_ids, []) AS first_ids
FROM documents d LEFT JOIN gone g USING (doc_id) LEFT JOIN used u USING (doc_id) LEFT JOIN parts p USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": OP6}
