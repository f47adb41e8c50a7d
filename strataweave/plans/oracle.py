"""The SQL that says what the queries of the catalog must return, written for DuckDB from the tables alone."""

from __future__ import annotations

WEIGHT = "CASE type WHEN 'belongs_to' THEN 0.15 WHEN 'touches' THEN 0.3 WHEN 'mentions' THEN 0.6 WHEN 'references' THEN 0.8 WHEN 'calls' THEN 1.0 WHEN 'imports' THEN 1.0 WHEN 'defines' THEN 1.0 ELSE 0.5 END::DOUBLE"

BASE = """
files AS MATERIALIZED (
  SELECT 'customers/n' || c_nationkey || '/c' || c_custkey || '.py' AS path, length(c_name)::BIGINT AS size, 'code' AS category, 'core' AS layer FROM customer
  UNION ALL SELECT 'suppliers/n' || s_nationkey || '/s' || s_suppkey || '.go', length(s_name), 'code', 'core' FROM supplier
  UNION ALL SELECT 'nations/' || n_nationkey || '.toml', length(n_name), 'config', 'config' FROM nation
  UNION ALL SELECT 'docs/region' || r_regionkey || '.md', length(r_name), 'doc', 'docs' FROM region
  UNION ALL SELECT 'docs/' || lang || '/d' || doc_id || '.md', n_chars, 'doc', 'docs' FROM documents),
sales AS MATERIALIZED (
  SELECT o_orderkey, o_custkey, o_orderdate, 'customers/n' || c_nationkey || '/c' || c_custkey || '.py' AS file, 'customers/n' || c_nationkey || '/c' || c_custkey || '.py#o' || o_orderkey AS id
  FROM orders JOIN customer ON c_custkey = o_custkey),
nodes AS MATERIALIZED (
  SELECT path AS id, 'file' AS kind, regexp_extract(path, '[^/]*$') AS label, path, category, size, NULL::INTEGER AS line, layer FROM files
  UNION ALL SELECT DISTINCT 'area:' || split_part(path, '/', 1), 'area', split_part(path, '/', 1), NULL, NULL, NULL, NULL, 'other' FROM files
  UNION ALL SELECT id, 'symbol', 'o' || o_orderkey, file, NULL, NULL, o_orderkey::INTEGER, 'other' FROM sales
  UNION ALL SELECT DISTINCT 'decision:ADR-' || quality, 'decision', 'ADR-' || quality, NULL, NULL, NULL, NULL, 'other' FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)
  UNION ALL SELECT DISTINCT 'session:' || strftime(ts, '%Y-%m-%d'), 'session', strftime(ts, '%Y-%m-%d'), NULL, NULL, NULL, NULL, 'other' FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
edges AS MATERIALIZED (
  SELECT path AS src, 'area:' || split_part(path, '/', 1) AS dst, 'belongs_to' AS type FROM files
  UNION ALL SELECT file, id, 'defines' FROM sales
  UNION ALL SELECT id, before, 'calls' FROM (SELECT id, lag(id) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM sales) WHERE before IS NOT NULL
  UNION ALL SELECT DISTINCT file, 'suppliers/n' || s_nationkey || '/s' || s_suppkey || '.go', 'imports' FROM sales JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN supplier ON s_suppkey = l_suppkey
  UNION ALL SELECT 'suppliers/n' || s_nationkey || '/s' || s_suppkey || '.go', 'nations/' || s_nationkey || '.toml', 'imports' FROM supplier
  UNION ALL SELECT 'docs/region' || n_regionkey || '.md', 'nations/' || n_nationkey || '.toml', 'references' FROM nation
  UNION ALL SELECT DISTINCT 'docs/' || lang || '/d' || doc_id || '.md', 'decision:ADR-' || quality, 'mentions' FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT DISTINCT 'session:' || strftime(ts, '%Y-%m-%d'), 'customers/n' || c_nationkey || '/c' || c_custkey || '.py', 'touches' FROM events JOIN customer ON c_custkey = user_id),
deg AS MATERIALIZED (SELECT nodes.id, count(e.id)::BIGINT AS deg FROM nodes LEFT JOIN (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) e ON e.id = nodes.id GROUP BY nodes.id)"""

ROWS = """,
cards AS MATERIALIZED (
  SELECT n.id, kind, category AS cat, size, line, deg,
    '{"id": "' || n.id || '", "kind": "' || kind || '"' || coalesce(', "cat": "' || category || '"', '') || CASE WHEN kind = 'file' THEN ', "size": ' || size ELSE '' END || CASE WHEN kind = 'symbol' AND line <> 0 THEN ', "line": ' || line ELSE '' END || ', "deg": ' || deg || '}' AS js
  FROM nodes n JOIN deg USING (id)),
costs AS (SELECT id, kind, cat, size, CASE WHEN line <> 0 THEN line END AS line, deg, greatest(1, round_even(length(js) / 4.0, 0))::INTEGER AS cost FROM cards)"""

HALF = f""",
half AS MATERIALIZED (SELECT a, b, sum(w) AS w FROM (SELECT src AS a, dst AS b, {WEIGHT} AS w FROM edges UNION ALL SELECT dst, src, {WEIGHT} FROM edges) GROUP BY a, b),
total AS MATERIALIZED (SELECT a, sum(w) AS t FROM half GROUP BY a)"""


def walk(restart: str, iterations: int) -> str:
    """Power iterations from and back to a restart table (id, r)."""
    out = HALF + f",\nr AS MATERIALIZED ({restart}),\ns0 AS MATERIALIZED (SELECT id, r AS score FROM r)"
    for k in range(iterations):
        out += f""",
s{k + 1} AS MATERIALIZED (SELECT r.id, 0.15 * r.r + 0.85 * coalesce(g.got, 0) + 0.85 * coalesce((SELECT sum(score) FROM s{k} WHERE id NOT IN (SELECT a FROM total)), 0) * r.r AS score
  FROM r LEFT JOIN (SELECT b AS id, sum(score * w / t) AS got FROM half JOIN total USING (a) JOIN s{k} ON s{k}.id = a GROUP BY b) g ON g.id = r.id)"""
    return out


UNIFORM = "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes"


def seeded(seeds: str) -> str:
    return f"SELECT id, CASE WHEN id IN ({seeds}) THEN 1.0::DOUBLE / (SELECT count(*) FROM nodes WHERE id IN ({seeds})) ELSE 0.0 END AS r FROM nodes"


def reached(seed: str, dependents: bool, hops: int) -> str:
    one, other = ("dst", "src") if dependents else ("src", "dst")
    out = f",\nlinks AS MATERIALIZED (SELECT DISTINCT {one} AS id, {other} AS nxt FROM edges WHERE type IN ('calls', 'defines', 'imports', 'references')),\n"
    out += f"d0 AS (SELECT '{seed}' AS id, 0 AS dist UNION SELECT dst, 0 FROM edges WHERE type = 'defines' AND src = '{seed}' UNION SELECT src, 0 FROM edges WHERE type = 'defines' AND dst = '{seed}')"
    for k in range(hops):
        out += f",\nd{k + 1} AS MATERIALIZED (SELECT id, min(dist)::INTEGER AS dist FROM (SELECT * FROM d{k} UNION ALL SELECT nxt, dist + 1 FROM d{k} JOIN links USING (id) WHERE dist = {k}) GROUP BY id)"
    return out


def budgeted(ranked: str, budget: int) -> str:
    """rank (score desc, id) of ranked (id, score) within a budget."""
    return f""",
best AS (SELECT c.*, score, row_number() OVER (ORDER BY score DESC, id) AS rank, sum(cost) OVER (ORDER BY score DESC, id) AS used FROM costs c JOIN ({ranked}) USING (id)),
kept AS (SELECT * FROM best WHERE rank = 1 OR used <= {budget})"""


def tour(stops: int) -> str:
    """The reading order of the best files by s60: of those whose needs are met, or of all, the highest (score, id), again and again."""
    out = f""",
best AS MATERIALIZED (SELECT id, layer, round(score, 12) AS score FROM nodes JOIN s60 USING (id) WHERE kind = 'file' ORDER BY 3 DESC, id LIMIT {stops}),
owned AS (SELECT id, CASE WHEN kind = 'symbol' THEN path ELSE id END AS file FROM nodes),
needs AS MATERIALIZED (
  SELECT DISTINCT a.file AS u, b.file AS v FROM edges JOIN owned a ON a.id = src JOIN owned b ON b.id = dst
  WHERE type IN ('calls', 'imports', 'references') AND a.file <> b.file AND a.file IN (SELECT id FROM best) AND b.file IN (SELECT id FROM best))"""
    done = "SELECT NULL::VARCHAR AS id"
    for k in range(1, stops + 1):
        waits = f"EXISTS (SELECT 1 FROM needs WHERE u = best.id AND v NOT IN (SELECT id FROM o WHERE id IS NOT NULL))"
        out += f",\no{k} AS MATERIALIZED (WITH o AS ({done}) SELECT {k}::INTEGER AS step, id FROM best WHERE id NOT IN (SELECT id FROM o WHERE id IS NOT NULL) ORDER BY {waits}, score DESC, id DESC LIMIT 1)"
        done += f" UNION ALL SELECT id FROM o{k}"
    three = lambda side, key: f"coalesce((SELECT list({side} ORDER BY f.score DESC, {side})[1:3] FROM needs JOIN best f ON f.id = {side} WHERE {key} = q.id), [])"
    order = " UNION ALL ".join(f"SELECT * FROM o{k}" for k in range(1, stops + 1))
    return out + f""",
shown AS (SELECT step, q.id, layer, round(score, 5) AS score, {three('v', 'u')} AS uses, {three('u', 'v')} AS used_by FROM ({order}) q JOIN best USING (id)),
stops AS (SELECT *, sum(greatest(1, round_even(length(concat_ws(' ', id, array_to_string(uses, ' '), array_to_string(used_by, ' '))) / 4.0, 0))) OVER (ORDER BY step) AS used FROM shown)"""
