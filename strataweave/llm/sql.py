"""DuckDB SQL for the operators that SQL can express."""

WORDS = r"regexp_extract_all(lower({}), '[0-9a-z_\x{{80}}-\x{{10FFFF}}]+')"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT DISTINCT doc_id, i - 1 AS line, list_sort(list_distinct({WORDS.format("p[i]")})) AS words
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
named AS (SELECT doc_id, line, words FROM lines WHERE len(words) > 0),
sets AS (SELECT row_number() OVER (ORDER BY words) AS s, words, len(words) AS n, min((doc_id, line)) AS spot FROM named GROUP BY words),
item AS (SELECT s, n, unnest(words) AS w FROM sets),
rare AS (SELECT w, count(*) AS c FROM item GROUP BY w),
prefix AS (SELECT s, n, w FROM (SELECT item.s, item.n, item.w, row_number() OVER (PARTITION BY s ORDER BY c, w) AS k FROM item JOIN rare USING (w)) WHERE k <= n - ceil(0.9 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.s AS sa, b.s AS sb FROM prefix a JOIN prefix b ON a.w = b.w AND a.s <> b.s AND a.n >= 0.9 * b.n - 1e-9 AND b.n >= 0.9 * a.n - 1e-9),
near AS (
  SELECT sa, sb, len(list_intersect(a.words, b.words)) AS shared, a.n + b.n - len(list_intersect(a.words, b.words)) AS u, b.spot AS spot
  FROM cand JOIN sets a ON a.s = sa JOIN sets b ON b.s = sb),
other AS (SELECT sa AS s, min((spot, shared / u)) AS o FROM near WHERE shared / u >= 0.9 - 1e-9 GROUP BY sa),
ranked AS (
  SELECT named.doc_id, named.line, sets.spot AS same, other.o[1] AS spot, other.o[2] AS jaccard
  FROM named JOIN sets USING (words) LEFT JOIN other ON other.s = sets.s),
best AS (SELECT doc_id, line, CASE WHEN spot < same THEN spot ELSE same END AS kept, CASE WHEN spot < same THEN jaccard ELSE 1.0 END AS jaccard FROM ranked)
SELECT DISTINCT doc_id, line::INTEGER AS line, kept[1] AS kept_doc_id, kept[2]::INTEGER AS kept_line, jaccard FROM best WHERE kept < (doc_id, line)
"""

NGRAM_JACCARD = f"""
WITH RECURSIVE words AS (SELECT DISTINCT doc_id, {WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
docs AS (
  SELECT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) END AS grams
  FROM words WHERE len(w) > 0),
sets AS (SELECT row_number() OVER (ORDER BY grams) AS s, grams, len(grams) AS n, min(doc_id) AS rep FROM docs GROUP BY grams),
item AS (SELECT s, n, unnest(grams) AS g FROM sets),
rare AS (SELECT g, count(*) AS c FROM item GROUP BY g),
prefix AS (SELECT s, n, g FROM (SELECT item.s, item.n, item.g, row_number() OVER (PARTITION BY s ORDER BY c, g) AS k FROM item JOIN rare USING (g)) WHERE k <= n - ceil(0.7 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.s AS sa, b.s AS sb FROM prefix a JOIN prefix b ON a.g = b.g AND a.s < b.s AND a.n >= 0.7 * b.n - 1e-9 AND b.n >= 0.7 * a.n - 1e-9),
near AS (
  SELECT sa, sb, a.rep AS ra, b.rep AS rb
  FROM cand JOIN sets a ON a.s = sa JOIN sets b ON b.s = sb
  WHERE len(list_intersect(a.grams, b.grams)) / (a.n + b.n - len(list_intersect(a.grams, b.grams))) >= 0.7 - 1e-9),
linked AS (SELECT s, count(*) AS links FROM (SELECT sa AS s FROM near UNION ALL SELECT sb FROM near) GROUP BY s),
held AS (SELECT DISTINCT doc_id, s, rep FROM docs JOIN sets USING (grams)),
counted AS (SELECT s, count(*) - 1 AS copies FROM held GROUP BY s),
edge AS (SELECT ra AS a, rb AS b FROM near UNION SELECT rb, ra FROM near UNION SELECT rep, doc_id FROM held UNION SELECT doc_id, rep FROM held),
reach AS (SELECT doc_id AS a, doc_id AS b FROM held UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
total AS (SELECT doc_id, sum(copies) AS copies, sum(coalesce(links, 0)) AS links FROM held JOIN counted USING (s) LEFT JOIN linked USING (s) GROUP BY doc_id)
SELECT DISTINCT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(copies, 0)::BIGINT AS copies, coalesce(links, 0)::BIGINT AS links
FROM documents d LEFT JOIN class USING (doc_id) LEFT JOIN total USING (doc_id) WHERE d.doc_id IS NOT NULL
"""
