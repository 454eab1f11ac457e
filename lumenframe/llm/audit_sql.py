"""SQL twins of the two audits, in which every count is spelled out."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

REMOVAL_RANKS = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
words AS (SELECT *, {_WORDS} AS words FROM texts),
judged AS (
  SELECT w.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * len(regexp_extract_all(w.text, '[A-Z]')) > 5 * length(w.text) AS c,
    regexp_matches(w.text, '[#$%&*|]') AS d, coalesce(w.doc_id > l.least, false) AS e
  FROM words w JOIN least l ON w.text = l.text LEFT JOIN marks m ON w.doc_id = m.doc_id),
sets AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
fails AS (
  SELECT *, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM sets),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || letter FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS f(letter) WHERE NOT contains(o, letter)),
steps AS (SELECT o AS filter_order, s AS step, substr(o, s, 1) AS letter, substr(o, 1, s - 1) AS earlier
  FROM orders, generate_series(1, 5) AS g(s) WHERE length(o) = 5),
cells AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT gone AND NOT here THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND here THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND here THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND here THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND here THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, regexp_matches(failed, '[' || earlier || '-]') AS gone, contains(failed, letter) AS here FROM fails, steps) f GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM cells
"""

DIVERGENCE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM texts),
tokens AS (SELECT r, lang, source, unnest(terms) AS term FROM texts),
kept AS (SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
here AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
there AS (SELECT lang, term, sum(n) AS n FROM here GROUP BY ALL),
totals AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN here h ON g.lang = h.lang AND g.source = h.source GROUP BY ALL),
lang_totals AS (SELECT lang, sum(total) AS total FROM totals GROUP BY ALL),
p AS (
  SELECT t.lang, t.source, k.term, coalesce(h.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (t.total + s.v)::HUGEINT)::BIGINT AS p
  FROM totals t JOIN kept k ON t.lang = k.lang JOIN sizes s ON t.lang = s.lang LEFT JOIN here h ON h.lang = t.lang AND h.source = t.source AND h.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair_rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 1)) // (total + v)::HUGEINT)::BIGINT AS q FROM there JOIN lang_totals USING (lang) JOIN sizes USING (lang)),
term_rows AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair_rows UNION ALL SELECT * FROM term_rows))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
