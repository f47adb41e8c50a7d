"""The queries over the star-schema graph and its tables, and the SQL that says what they must return.

Texts for extraction are made of columns by the same concatenations on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.labels import category, layer
from ..functions.paths import normalised
from ..functions.syntax import parsed
from ..model import Graph
from ..operators import graph as g
from ..operators.budget import rows_with_cost, within_budget
from ..operators.export import dot_lines, jgf_nodes, native_edges, native_nodes, view_nodes
from ..operators.rank import pagerank, top_ranked
from ..operators.traverse import expanded, reach, resolve_seeds, seed_scores, shortest_path, steps
from ..sources.history import parsed_log
from ..sources.star import star_graph, table
from . import build, gate, oracle, query

SEED = "nations/7.toml"
PHRASE = "customers/n7"
SCALE = 9
#: Queries that go over the graph more than a few times; for them it is written once.
SEVERAL_PASSES = set("backbone budget_prefix focus focus_30 impact pagerank_10 personal_pagerank_10 project_map reach_dependencies reach_dependents shortest_chain top_files tour view_rows why_steps".split())
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query_of(sql: str | None = None):
    """Registers a function of (spark, sf_dir) and its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def on_graph(sql: str | None = None, ctes: str = ""):
    """The same for functions of the graph; ctes come behind the tables of the graph."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            graph = star_graph(spark, sf_dir)
            return f(graph.stored() if f.__name__ in SEVERAL_PASSES else graph)

        run.__name__ = f.__name__
        query_of(None if sql is None else f"WITH RECURSIVE {oracle.BASE}{ctes}\n{sql}")(run)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows over many tasks: a table in a small file is read by one, which would search all the texts made of it."""
    spark = rows.sparkSession
    return rows.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def _ids(graph: Graph, ids: list[str]) -> DataFrame:
    return graph.spark.createDataFrame([(i,) for i in ids], "id string")


# -- primitives


@on_graph("SELECT 'node' AS what, kind AS name, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def graph_counts(graph):
    return g.counts(graph)


@on_graph("SELECT id, deg FROM deg")
def node_degrees(graph):
    return g.degrees(graph)


@on_graph("SELECT id, deg FROM deg ORDER BY deg DESC, id LIMIT 20")
def degree_top(graph):
    return g.degrees(graph).orderBy(F.desc("deg"), "id").limit(20)


@on_graph("SELECT path AS id FROM files WHERE path NOT IN (SELECT src FROM edges WHERE type <> 'belongs_to' UNION SELECT dst FROM edges WHERE type <> 'belongs_to')")
def orphans(graph):
    return g.orphans(graph)


@on_graph("SELECT a, b, round(w, 6) AS w FROM half", oracle.HALF)
def undirected_weights(graph):
    return g.undirected_weights(graph).select("a", "b", F.round("w", 6).alias("w"))


@on_graph(f"SELECT 'out' AS dir, dst AS id, kind, type AS edge FROM edges JOIN nodes ON id = dst WHERE src = '{SEED}' UNION ALL SELECT 'in', src, kind, type FROM edges JOIN nodes ON id = src WHERE dst = '{SEED}'")
def neighbors_of(graph):
    return query.neighbour_rows(graph, SEED)


@on_graph(f"SELECT DISTINCT CASE WHEN src = '{SEED}' THEN dst ELSE src END AS id FROM edges WHERE src = '{SEED}' OR dst = '{SEED}'")
def neighbor_ids(graph):
    return g.neighbour_ids(graph, SEED)


@on_graph("SELECT id, kind, path FROM nodes WHERE kind <> 'area' AND (lower(label) LIKE '%c12%' OR lower(path) LIKE '%c12%' OR lower(id) LIKE '%c12%') ORDER BY id LIMIT 25")
def find_substring(graph):
    return query.find(graph, " C12 ")


@on_graph(f"SELECT src, dst, type FROM edges WHERE src LIKE '{PHRASE}/%' AND dst LIKE '{PHRASE}/%'")
def induced_edges(graph):
    return g.induced_edges(graph, graph.nodes.where(F.col("id").startswith(PHRASE + "/"))).select("src", "dst", "type")


@on_graph("SELECT id, kind FROM (SELECT id, kind FROM nodes JOIN s10 USING (id) ORDER BY round(score, 12) DESC, id LIMIT 1500) UNION SELECT id, kind FROM nodes WHERE kind = 'area'", oracle.walk(oracle.UNIFORM, 10))
def backbone(graph):
    scores = pagerank(graph, iterations=10, tolerance=0.0).withColumn("score", F.round("score", 12))
    return g.backbone(graph, 1500, scores).nodes.select("id", "kind")


# -- labels, budgets, digests


@on_graph("SELECT path, category, layer FROM files")
def file_labels(graph):
    files = graph.nodes.where("kind = 'file'")
    return files.select("path", "category", layer(F.col("kind"), F.col("path"), F.col("category")).alias("layer"))


@query_of(
    """SELECT path, CASE WHEN ext IN ('c', 'py', 'rs', 'sql') THEN 'code' WHEN ext IN ('csv', 'parquet') THEN 'data' WHEN ext IN ('toml', 'yaml', 'zzz') THEN 'config' ELSE 'doc' END AS category,
    CASE WHEN dir = 'tests' THEN 'tests' WHEN ext IN ('csv', 'parquet') THEN 'data' WHEN ext IN ('toml', 'yaml', 'zzz') THEN 'config' WHEN ext NOT IN ('c', 'py', 'rs', 'sql') THEN 'docs'
      WHEN dir = 'cmd' THEN 'entrypoint' WHEN dir = 'routes' THEN 'api' WHEN dir = 'views' THEN 'ui' WHEN dir = 'models' THEN 'data' WHEN dir = 'workers' THEN 'service' WHEN dir = 'libs' THEN 'util' ELSE 'core' END AS layer
    FROM (SELECT dir || '/p' || p_partkey || '.' || ext AS path, dir, ext FROM (SELECT p_partkey, ['tests', 'cmd', 'routes', 'views', 'models', 'workers', 'libs', 'src'][p_partkey % 8 + 1] AS dir, ['py', 'c', 'rs', 'sql', 'csv', 'parquet', 'toml', 'yaml', 'zzz', 'md', 'txt'][p_partkey % 11 + 1] AS ext FROM part))"""
)
def path_labels(spark, sf_dir):
    """Categories and layers of many kinds of paths."""
    dirs, exts = "tests cmd routes views models workers libs src".split(), "py c rs sql csv parquet toml yaml zzz md txt".split()
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % len(words) + 1).cast("int"))
    path = table(spark, sf_dir, "part").select(F.concat(pick(dirs), F.lit("/p"), "p_partkey", F.lit("."), pick(exts)).alias("path")).withColumn("category", category(F.col("path")))
    return path.withColumn("layer", layer(F.lit("file"), F.col("path"), F.col("category")))


@on_graph(
    """SELECT area, sum(n)::BIGINT AS files, sum(size)::BIGINT AS size, array_to_string(list(category ORDER BY n DESC, category)[1:3], ',') AS top_cats
    FROM (SELECT split_part(path, '/', 1) AS area, category, count(*) AS n, sum(size) AS size FROM files GROUP BY ALL) GROUP BY area"""
)
def area_digest(graph):
    return query.area_digest(graph, None).withColumn("top_cats", F.array_join("top_cats", ","))


@on_graph("SELECT layer, count(*) AS files, sum(size)::BIGINT AS size FROM files GROUP BY layer")
def layer_summary(graph):
    return query.layer_summary(graph)


@on_graph("SELECT id, cost FROM costs", oracle.ROWS)
def token_cost(graph):
    return rows_with_cost(graph).select("id", "cost")


@on_graph("SELECT id, kind, coalesce(cat, '') AS cat, coalesce(size::VARCHAR, '') AS size, coalesce(line::VARCHAR, '') AS line, deg, cost, rank, used::BIGINT AS used FROM kept", oracle.ROWS + oracle.budgeted("SELECT id, deg AS score FROM deg", 1500))
def budget_prefix(graph):
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("cat", "size", "line")]
    return within_budget(graph, g.degrees(graph).select("id", F.col("deg").alias("score")), 1500).select("id", "kind", *shown, "deg", "cost", F.col("rank").cast("long").alias("rank"), "used")


# -- ranking


@on_graph(f"SELECT id, round(score, {SCALE}) AS score FROM s10", oracle.walk(oracle.UNIFORM, 10))
def pagerank_10(graph):
    return pagerank(graph, iterations=10, tolerance=0.0).select("id", F.round("score", SCALE).alias("score"))


PHRASE_SEEDS = f"SELECT n.id FROM nodes n JOIN deg USING (id) WHERE kind <> 'area' AND lower(n.id || ' ' || label) LIKE '%{PHRASE}%' ORDER BY deg DESC, n.id LIMIT 25"


@on_graph(f"SELECT id, round(score, {SCALE}) AS score FROM s10", f",\npicked AS MATERIALIZED ({PHRASE_SEEDS})" + oracle.walk(oracle.seeded("SELECT id FROM picked"), 10))
def personal_pagerank_10(graph):
    seeds = _ids(graph, resolve_seeds(graph, PHRASE)).withColumn("weight", F.lit(1.0))
    return pagerank(graph, seeds, iterations=10, tolerance=0.0).select("id", F.round("score", SCALE).alias("score"))


@on_graph("SELECT id, kind, round(score, 12) AS score FROM nodes JOIN s10 USING (id) WHERE kind = 'file' ORDER BY 3 DESC, id LIMIT 50", oracle.walk(oracle.UNIFORM, 10))
def top_files(graph):
    scores = pagerank(graph, iterations=10, tolerance=0.0).withColumn("score", F.round("score", 12))
    return top_ranked(graph, scores, "file", 50).select("id", F.lit("file").alias("kind"), "score")


# -- seeds and traversal


@on_graph(
    """SELECT id, score FROM (SELECT id, (100 * CASE WHEN hay LIKE '%supplier region_%' THEN 3 WHEN hay LIKE '%supplier region s7%' THEN 3 ELSE (hay LIKE '%supplier%')::INT + (hay LIKE '%region%')::INT + (hay LIKE '%s7%')::INT END)::BIGINT AS hits, deg
    FROM (SELECT n.id, lower(n.id || ' ' || label) AS hay, deg FROM nodes n JOIN deg USING (id) WHERE kind <> 'area')) q, LATERAL (SELECT hits + deg AS score) WHERE hits > 0"""
)
def seed_ranking(graph):
    return seed_scores(graph, " Supplier/region S7 ")


@on_graph("SELECT id, dist FROM d6", oracle.reached(SEED, True, 6))
def reach_dependents(graph):
    return reach(graph, expanded(graph, _ids(graph, [SEED])), True, 6)


@on_graph("SELECT id, dist FROM d6", oracle.reached("docs/region1.md", False, 6))
def reach_dependencies(graph):
    return reach(graph, expanded(graph, _ids(graph, ["docs/region1.md"])), False, 6)


ENDS = ("docs/region2.md", "suppliers/")
PATH_SQL = """,
goal AS (SELECT max(id) AS id FROM nodes WHERE id LIKE 'suppliers/%'),
both_ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
p0 AS MATERIALIZED (SELECT 'docs/region2.md' AS id, ['docs/region2.md'] AS path)""" + "".join(
    f",\np{k + 1} AS MATERIALIZED (SELECT b AS id, min(list_append(path, b)) AS path FROM p{k} JOIN both_ways ON a = id WHERE b NOT IN ({' UNION ALL '.join(f'SELECT id FROM p{j}' for j in range(k + 1))}) GROUP BY b)" for k in range(6)
)


@on_graph(f"SELECT unnest(range(1, len(path) + 1))::INTEGER - 1 AS step, unnest(path) AS id FROM ({' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(7))}) WHERE id = (SELECT id FROM goal)", PATH_SQL)
def shortest_chain(graph):
    """The shortest path from a region's document to the last supplier."""
    goal = graph.nodes.where(F.col("id").startswith(ENDS[1])).agg(F.max("id")).first()[0]
    path = shortest_path(graph, ENDS[0], goal) if goal else []
    return steps(graph, path).select("step", "id")


WHY = """SELECT step, q.id, kind, CASE WHEN step > 0 THEN coalesce(forth, back) END AS edge, CASE WHEN step > 0 THEN CASE WHEN forth IS NOT NULL THEN '->' ELSE '<-' END END AS dir
FROM (SELECT unnest(range(1, len(path) + 1))::INTEGER - 1 AS step, unnest(path) AS id, unnest(list_prepend(NULL, path[:-2])) AS prev FROM (%s) WHERE id = (SELECT id FROM goal)) q
JOIN nodes ON nodes.id = q.id LEFT JOIN (SELECT src, dst, min(type) AS forth FROM edges GROUP BY ALL) f ON f.src = prev AND f.dst = q.id LEFT JOIN (SELECT src, dst, min(type) AS back FROM edges GROUP BY ALL) b ON b.src = q.id AND b.dst = prev"""


@on_graph(WHY % " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(7)), PATH_SQL)
def why_steps(graph):
    goal = graph.nodes.where(F.col("id").startswith(ENDS[1])).agg(F.max("id")).first()[0]
    return steps(graph, shortest_path(graph, ENDS[0], goal) if goal else [])


# -- composed queries


FOCUS = f",\npicked AS MATERIALIZED ({PHRASE_SEEDS})" + oracle.walk(oracle.seeded("SELECT id FROM picked"), 60) + oracle.ROWS + oracle.budgeted("SELECT id, round(score, 12) AS score FROM s60", 400)


@on_graph("SELECT rank, id, kind, cat, size, line, deg, round(score, 5) AS score, used::BIGINT AS used FROM kept", FOCUS)
def focus(graph):
    return query.focus_rows(graph, resolve_seeds(graph, PHRASE), 400).select("rank", "id", "kind", "cat", "size", "line", "deg", F.round("score", 5).alias("score"), "used")


FOCUS_30 = f",\npicked AS MATERIALIZED ({PHRASE_SEEDS})" + oracle.walk(oracle.seeded("SELECT id FROM picked"), 30) + oracle.ROWS + oracle.budgeted("SELECT id, round(score, 12) AS score FROM s30", 400)


@on_graph("SELECT id, deg, cost, used::BIGINT AS used FROM kept", FOCUS_30)
def focus_30(graph):
    """The focused subgraph after 30 iterations, as SQL can count them."""
    seeds = _ids(graph, resolve_seeds(graph, PHRASE)).withColumn("weight", F.lit(1.0))
    scores = pagerank(graph, seeds, iterations=30, tolerance=0.0).withColumn("score", F.round("score", 12))
    return within_budget(graph, scores, 400).select("id", "deg", "cost", "used")


IMPACT = oracle.reached(SEED, True, 12) + ",\nhit AS MATERIALIZED (SELECT id, dist FROM d12 WHERE dist > 0)"
IMPACT += oracle.walk("SELECT id, coalesce(1.0::DOUBLE / (1 + dist) / (SELECT sum(1.0::DOUBLE / (1 + dist)) FROM hit), 0.0) AS r FROM nodes LEFT JOIN hit USING (id)", 60)
IMPACT += oracle.ROWS + oracle.budgeted("SELECT id, round(score, 12) AS score FROM s60 JOIN hit USING (id)", 1500)


@on_graph("SELECT rank, id, kind, deg, dist, round(score, 5) AS score, used::BIGINT AS used FROM kept JOIN hit USING (id)", IMPACT)
def impact(graph):
    hit = query.affected(graph, [SEED])
    return query.impact_rows(graph, hit, 1500).select("rank", "id", "kind", "deg", "dist", F.round("score", 5).alias("score"), "used")


@on_graph("SELECT step, id, layer, score, uses, used_by, used::BIGINT AS used FROM stops WHERE step = 1 OR used <= 2000", oracle.walk(oracle.UNIFORM, 60) + oracle.tour(40))
def tour(graph):
    return query.tour_stops(graph, 2000, 40)


MAP = """SELECT 'total' AS part, 'files' AS name, count(*)::DOUBLE AS value FROM files UNION ALL SELECT 'total', 'size', sum(size)::DOUBLE FROM files UNION ALL SELECT 'total', 'areas', count(DISTINCT split_part(path, '/', 1)) FROM files
UNION ALL SELECT 'total', 'symbols', count(*) FROM nodes WHERE kind = 'symbol' UNION ALL SELECT 'total', 'edges', count(*) FROM edges UNION ALL SELECT 'total', 'broken_refs', 0
UNION ALL SELECT 'total', 'orphans', count(*) FROM files WHERE path NOT IN (SELECT src FROM edges WHERE type <> 'belongs_to' UNION SELECT dst FROM edges WHERE type <> 'belongs_to')
UNION ALL SELECT 'node_kinds', kind, count(*) FROM nodes GROUP BY kind UNION ALL SELECT 'edge_types', type, count(*) FROM edges GROUP BY type
UNION ALL SELECT 'area ' || k, area, CASE k WHEN 'files' THEN n ELSE size END FROM (SELECT split_part(path, '/', 1) AS area, count(*) AS n, sum(size) AS size FROM files GROUP BY area ORDER BY size DESC, area LIMIT 8), (SELECT unnest(['files', 'size']) AS k)
UNION ALL SELECT 'layer ' || k, layer, CASE k WHEN 'files' THEN n ELSE size END FROM (SELECT layer, count(*) AS n, sum(size) AS size FROM files GROUP BY layer), (SELECT unnest(['files', 'size']) AS k)
UNION ALL SELECT 'important ' || kind, id, round(score, 5) FROM (SELECT id, kind, round(score, 12) AS score FROM nodes JOIN s60 USING (id) ORDER BY score DESC, id LIMIT 8)"""


@on_graph(MAP, oracle.walk(oracle.UNIFORM, 60))
def project_map(graph):
    """The digest as rows of numbers."""
    digest = query.project_map(graph)
    rows = [("total", k, v) for k, v in digest.items() if isinstance(v, int)] + [(part, k, v) for part in ("node_kinds", "edge_types") for k, v in digest[part].items()]
    rows += [(f"{what} {k}", r[what], r[k]) for what, part in (("area", "by_area"), ("layer", "by_layer")) for r in digest[part] for k in ("files", "size")]
    rows += [(f"important {r['kind']}", r["id"], r["score"]) for r in digest["most_important"]]
    return graph.spark.createDataFrame([(a, b, float(v)) for a, b, v in rows], "part string, name string, value double")


# -- exports


DOT = """SELECT 1 AS part, id AS a, '' AS b, '' AS c, '  "' || id || '" [label="' || label || '", fillcolor="' || CASE kind WHEN 'area' THEN '#ef6c00' WHEN 'decision' THEN '#8e24aa' WHEN 'file' THEN '#1e66b4' WHEN 'session' THEN '#78909c' ELSE '#2e8b57' END || '", fontcolor=white];' AS line FROM nodes
UNION ALL SELECT 2, src, dst, type, '  "' || src || '" -> "' || dst || '" [label="' || type || '"];' FROM edges"""


@on_graph(DOT)
def dot_export(graph):
    return dot_lines(graph)


FACTS = """concat_ws(',', '"size":' || size, '"line":' || line, CASE WHEN kind = 'symbol' THEN '"symbol":"function"' END, CASE WHEN kind = 'session' THEN '"date":"' || label || '"' END)"""
NATIVE = f"""SELECT '{{"id":"' || id || '","kind":"' || kind || '","label":"' || label || '","path":' || coalesce('"' || path || '"', 'null') || ',"category":' || coalesce('"' || category || '"', 'null') || ',"description":"","meta":{{' || {FACTS} || '}}}}' AS json FROM nodes
UNION ALL SELECT '{{"source":"' || src || '","target":"' || dst || '","type":"' || type || '","meta":{{}}}}' FROM edges"""
JGF = f"""SELECT id, label, '{{' || concat_ws(',', '"kind":"' || kind || '"', '"category":"' || category || '"', '"path":"' || path || '"', nullif({FACTS}, '')) || '}}' AS facts FROM nodes"""


@on_graph(JGF)
def jgf_export(graph):
    return jgf_nodes(graph)


@on_graph(NATIVE)
def native_export(graph):
    return native_nodes(graph).select("json").union(native_edges(graph).select("json"))


@on_graph("SELECT id, kind, label, coalesce(path, '') AS path, deg, round(score, 6) AS score, CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '(root)' END AS area, layer FROM nodes JOIN deg USING (id) JOIN s60 USING (id)", oracle.walk(oracle.UNIFORM, 60))
def view_rows(graph):
    return view_nodes(graph)


@on_graph(f"SELECT 'out' AS side, dst AS other, type FROM edges WHERE src = '{SEED}' UNION ALL SELECT 'in', src, type FROM edges WHERE dst = '{SEED}' UNION ALL SELECT 'there', id, kind FROM nodes WHERE id = '{SEED}'")
def edges_of_node(graph):
    """Out-edges, in-edges, and whether there is such a node."""
    out, back = g.out_edges(graph, SEED), g.in_edges(graph, SEED)
    there = graph.nodes.where((F.col("id") == SEED) & F.lit(g.has_node(graph, SEED) and not g.has_node(graph, "nowhere")))
    return out.select(F.lit("out").alias("side"), F.col("dst").alias("other"), "type").union(back.select(F.lit("in"), "src", "type")).union(there.select(F.lit("there"), "id", "kind"))


# -- freshness


@query_of(
    """WITH old AS (SELECT 'd' || doc_id AS path, md5(text) AS sig FROM documents WHERE doc_id % 10 <> 3), new AS (SELECT 'd' || doc_id AS path, md5(CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END) AS sig FROM documents WHERE doc_id % 10 <> 7)
    SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old FULL JOIN new ON old.path = new.path WHERE old.sig IS DISTINCT FROM new.sig"""
)
def manifest_diff(spark, sf_dir):
    """Two states of the documents, made from one: some gone, some new, some with another text."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.pmod("doc_id", F.lit(10)).alias("k"), "text")
    old = docs.where("k <> 3").select("path", F.md5("text").alias("sig"))
    new = docs.where("k <> 7").select("path", F.md5(F.when(F.col("k") == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("sig"))
    return gate.diff_manifest(old, new)


# -- extraction from texts


@query_of(r"SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(text, '(?:^|[^\p{L}\p{M}\p{N}_./\\-])([0-9A-Za-z_][\p{L}\p{M}\p{N}_\-./\\]*\.[0-9A-Za-z]{1,8})\b', 1))::BIGINT AS n FROM documents) WHERE n > 0")
def prose_paths(spark, sf_dir):
    """How many path-shaped tokens each document has."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(extract.path_tokens(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query_of(r"SELECT page_id, unnest(regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*[''\"]([^\s>''\"]{1,300})', 1)) AS target FROM pages")
def page_targets(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(extract.attribute_targets(F.col("html"))).alias("target"))


@query_of("SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN ['d/p' || p_size || '.md'] WHEN 1 THEN ['q' || p_partkey || '.html', 'i' || p_size || '.csv'] ELSE [] END) AS target FROM part")
def html_refs(spark, sf_dir):
    """Of pages only attributes that name a known type count: no scripts, images, URLs or prose."""
    page = F.expr(
        """case p_partkey % 3 when 0 then concat('<a href="d/p', p_size, '.md#x"></a> <img src="i.png"> see src/a.py') when 1 then concat('<A HREF=''q', p_partkey, '.html?a=1''>é</A><script>[x](b.md)</script><a href = "i', p_size, '.csv">')
        else concat('<a href="https://x.org/', p_partkey, '.md"></a><a href="mailto:a@b.c"> [l](k.md)') end"""
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(extract.references(page, F.lit(True))).alias("r")).select("p_partkey", "r.target")


@query_of("SELECT DISTINCT o_orderkey, unnest(['ADR-' || o_orderkey % 50, 'RFC-' || o_custkey % 9, 'D-KEY-' || o_orderkey % 7]) AS decision FROM orders")
def decision_ids(spark, sf_dir):
    k = lambda c, n: (F.col(c) % n).cast("string")
    text = F.concat(F.lit("See ADR-"), k("o_orderkey", 50), F.lit(", RFC-"), k("o_custkey", 9), F.lit(" (and ADR-"), k("o_orderkey", 50), F.lit("), D-KEY-"), k("o_orderkey", 7), F.lit("."))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(extract.decisions(text)).alias("decision"))


@query_of(
    """WITH raw AS (SELECT o_orderkey, 'src/m' || o_custkey || '.py' AS a, 'docs/x' || o_orderkey % 13 || '.md' AS b, 'Idea ' || o_orderkey % 5 AS c FROM orders)
    SELECT o_orderkey, a AS target, 'link' AS kind, 0 AS ord FROM raw UNION ALL SELECT o_orderkey, c, 'wikilink', 1 FROM raw UNION ALL SELECT o_orderkey, b, 'path', 3 FROM raw"""
)
def doc_refs(spark, sf_dir):
    """Links, wikilinks and paths in prose; the URL doesn't count, and the second mention of a path neither."""
    text = F.expr("concat('[m](src/m', o_custkey, '.py#top) and [[Idea ', o_orderkey % 5, '|an idea]], `docs/x', o_orderkey % 13, '.md`; [w](https://x.org/a/b) and src/m', o_custkey, '.py')")
    rows = spread(table(spark, sf_dir, "orders"), "o_orderkey").select(F.col("o_orderkey").cast("string").alias("path"), F.lit(".md").alias("ext"), text.alias("text"))
    found = build.document_references(rows)
    return found.select(F.col("file").cast("long").alias("o_orderkey"), "target", "kind", F.col("ord").cast("int").alias("ord"))


def _pages_corpus(spark, sf_dir) -> DataFrame:
    """Documents that refer to customers, suppliers, nations and things that aren't there."""
    t = lambda n: table(spark, sf_dir, n)
    text = F.expr(
        "concat('[a](../', if(o_orderkey % 3 = 0, 'gone', 'kept'), '/c', o_custkey, '.py) [[n', o_custkey % 25, '.toml]] and [[Some Idea]] see kept/none', o_orderkey, '.py [d](../kept) [out](../../up.md) [x](http://a.b/c.md)')"
    )
    docs = spread(t("orders"), "o_orderkey").select(F.expr("concat('docs/o', o_orderkey, '.md')").alias("path"), text.alias("text"))
    return docs.union(t("customer").select(F.expr("concat('kept/c', c_custkey, '.py')"), F.lit(None).cast("string"))).union(t("nation").select(F.expr("concat('nat/n', n_nationkey, '.toml')"), F.lit(None).cast("string")))


def _resolved(spark, sf_dir) -> DataFrame:
    corpus = _pages_corpus(spark, sf_dir)
    docs = corpus.where("text is not null").withColumn("ext", F.lit(".md"))
    return build.resolved_references(build.document_references(docs), corpus, corpus.select(F.col("path").alias("id")))


@query_of("SELECT 'docs/o' || o_orderkey || '.md' AS src, CASE WHEN k = 1 THEN 'kept/c' || o_custkey || '.py' ELSE 'nat/n' || o_custkey % 25 || '.toml' END AS dst FROM orders, (SELECT unnest([1, 2]) AS k)")
def reference_resolution(spark, sf_dir):
    """By path, or by a base name that only one file has: a link into a folder that is gone still finds the file by its name."""
    return _resolved(spark, sf_dir).where("resolved is not null").select(F.col("file").alias("src"), F.col("resolved").alias("dst")).distinct()


@query_of("SELECT 'd/o' || o_orderkey || '.md' AS file, 'missing/m' || o_custkey || '.md' AS target FROM orders")
def broken_refs(spark, sf_dir):
    """Only links into the project that lead nowhere are broken: no prose paths, directories, ideas, outside paths or URLs."""
    text = F.expr("concat('[a](missing/m', o_custkey, '.md) [[Idea ', o_orderkey, ']] see lost/none', o_orderkey, '.py [d](../d) [out](../../up.md) [x](ftp://a.b/c) [y](mailto:a@b.c) [z](//host/q.md)')")
    corpus = spread(table(spark, sf_dir, "orders"), "o_orderkey").select(F.expr("concat('d/o', o_orderkey, '.md')").alias("path"), text.alias("text"))
    refs = build.resolved_references(build.document_references(corpus.withColumn("ext", F.lit(".md"))), corpus, corpus.select(F.col("path").alias("id")))
    return refs.where("broken").select("file", "target")


@query_of("SELECT key, count(*) AS n, min(path) AS low, max(path) AS high FROM (SELECT 'p' || p_size AS key, 'd' || p_partkey || '/p' || p_size || '.md' AS path FROM part) GROUP BY key")
def stem_index(spark, sf_dir):
    from ..functions.paths import basename, stem

    paths = table(spark, sf_dir, "part").select(F.expr("concat('d', p_partkey, '/p', p_size, '.md')").alias("path"))
    return build.name_index(paths, stem(basename(F.col("path"))))


@query_of(
    """WITH s AS (SELECT 'f' || o_custkey || '.py' AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, 'n' || o_orderkey % 700 AS name, 'f' || o_custkey || '.py#q' || o_orderkey AS id, ['n' || (o_orderkey * 7) % 700, 'n' || (o_orderkey + 1) % 1400] AS calls FROM orders),
    c AS (SELECT id AS src, file, unnest(calls) AS name FROM s), own AS (SELECT file, name, arg_min(id, seq) AS own FROM s GROUP BY ALL), only_ AS (SELECT name, min(id) AS one FROM s GROUP BY name HAVING count(*) = 1)
    SELECT DISTINCT src, coalesce(own, one) AS dst FROM c LEFT JOIN own USING (file, name) LEFT JOIN only_ USING (name) WHERE coalesce(own, one) <> src"""
)
def call_resolution(spark, sf_dir):
    """Orders as symbols of a file for each customer, calling names that are local, unique, ambiguous or unknown."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select(
        F.expr("concat('f', o_custkey, '.py')").alias("file"), seq.alias("seq"), F.expr("concat('n', o_orderkey % 700)").alias("name"), F.expr("concat('f', o_custkey, '.py#q', o_orderkey)").alias("id"), F.expr("array(concat('n', (o_orderkey * 7) % 700), concat('n', (o_orderkey + 1) % 1400))").alias("calls")
    )
    return build.call_edges(rows).select("src", "dst")


@query_of(
    """WITH files AS (SELECT 'pkg' || p_size || '/m' || p_partkey || '.py' AS path FROM part UNION ALL SELECT DISTINCT 'pkg' || p_size || '/__init__.py' FROM part)
    SELECT DISTINCT 'pkg' || p_size || '/m' || p_partkey || '.py' AS src, t AS dst FROM part, LATERAL (SELECT unnest(['pkg' || (p_partkey % 50) + 1 || '/__init__.py', 'pkg' || p_size || '/m' || p_partkey + 1 || '.py', 'pkg' || p_size || '/__init__.py']) AS t) WHERE t IN (SELECT path FROM files) AND t <> 'pkg' || p_size || '/m' || p_partkey || '.py'"""
)
def import_resolution(spark, sf_dir):
    """Absolute imports of packages and relative imports of neighbours."""
    part = table(spark, sf_dir, "part")
    own = F.expr("concat('pkg', p_size, '/m', p_partkey, '.py')")
    corpus = part.select(own.alias("path")).union(part.select(F.expr("concat('pkg', p_size, '/__init__.py')")).distinct())
    absolute = part.select(own.alias("file"), F.lit(0).alias("level"), F.expr("concat('pkg', p_partkey % 50 + 1)").alias("module"), F.expr("array('none')").alias("names"))
    relative = part.select(own, F.lit(1), F.lit(None).cast("string"), F.expr("array(concat('m', p_partkey + 1))"))
    package = part.select(own, F.lit(2), F.expr("concat('pkg', p_size)"), F.expr("cast(array() as array<string>)"))
    return build.python_imports(absolute.union(relative).union(package), build.module_map(corpus)).select("src", "dst")


@query_of("SELECT DISTINCT 'app/f' || o_orderkey || '.ts' AS src, CASE o_orderkey % 3 WHEN 0 THEN 'app/c' || o_custkey || '.ts' WHEN 1 THEN 'src/c' || o_custkey || '.ts' ELSE 'libs/p' || o_custkey % 25 || '/src/index.ts' END AS dst FROM orders")
def script_imports(spark, sf_dir):
    """Relative specifiers with compiled endings, aliases, and packages of a workspace by the longest name."""
    t = lambda n: table(spark, sf_dir, n)
    spec = F.expr("case o_orderkey % 3 when 0 then concat('./c', o_custkey, '.js') when 1 then concat('@/c', o_custkey) else concat('@w/p', o_custkey % 25) end")
    specs = t("orders").select(F.expr("concat('app/f', o_orderkey, '.ts')").alias("file"), spec.alias("spec"))
    ids = t("customer").select(F.explode(F.expr("array(concat('app/c', c_custkey, '.ts'), concat('src/c', c_custkey, '.ts'))")).alias("id")).union(t("nation").select(F.expr("concat('libs/p', n_nationkey, '/src/index.ts')")))
    packages = t("nation").select(F.expr("concat('@w/p', n_nationkey)").alias("name"), F.expr("concat('libs/p', n_nationkey)").alias("dir")).union(spark.createDataFrame([("@w", "libs")], "name string, dir string"))
    return build.script_imports(specs, ids, [("@/", "src")], packages).select("src", "dst")


@query_of("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'a/' || p_size || '/c.py' WHEN 1 THEN '../é' || p_size || '/b' WHEN 2 THEN '/x' || p_size WHEN 3 THEN '.' WHEN 4 THEN '//h' || p_size || '/y' ELSE 'ü ' || p_size || '/...' END AS path FROM part""")
def normal_paths(spark, sf_dir):
    odd = F.expr(
        """case p_partkey % 6 when 0 then concat('./a//b/../', p_size, '/x/./../c.py') when 1 then concat('../é', p_size, '/./b/') when 2 then concat('/../a/../x', p_size) when 3 then concat('p', p_size, '/..')
        when 4 then concat('//h', p_size, '//y') else concat('ü ', p_size, '/./...') end"""
    )
    return table(spark, sf_dir, "part").select("p_partkey", normalised(odd).alias("path"))


@query_of("SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN ['Ctl' || c_custkey, 'Mw' || c_nationkey] WHEN 1 THEN ['Cité' || c_custkey] ELSE [] END) AS name FROM customer")
def route_classes(spark, sf_dir):
    text = F.expr("case c_custkey % 3 when 0 then concat('Route::get([Ctl', c_custkey, '::class, Mw', c_nationkey, '::class, Ctl', c_custkey, '::class]);') when 1 then concat('App\\\\Cité', c_custkey, '::class, Été', c_custkey, '::class') else concat('Ctl', c_custkey, '::make() no class') end")
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(extract.class_names(text)).alias("name"))


@query_of("SELECT c_custkey, 'Ev' || c_custkey AS event, unnest(CASE c_custkey % 3 WHEN 0 THEN ['La' || c_nationkey, 'Lb' || c_nationkey] WHEN 1 THEN ['Lc' || c_custkey] ELSE [] END) AS listener FROM customer")
def event_listeners(spark, sf_dir):
    text = F.expr("case c_custkey % 3 when 0 then concat('Ev', c_custkey, '::class => [La', c_nationkey, '::class, Lb', c_nationkey, '::class], No::class => []') when 1 then concat('Ev', c_custkey, '::class=>[\n  Lc', c_custkey, '::class,\n]') else concat('Ev', c_custkey, ' => [La::class]') end")
    pairs = table(spark, sf_dir, "customer").select("c_custkey", F.explode(extract.listener_pairs(text)).alias("p"))
    return pairs.select("c_custkey", F.col("p.event").alias("event"), F.explode("p.listeners").alias("listener"))


@query_of("SELECT 'h' || event_id AS hash, event_type AS subject, strftime(ts, '%Y-%m-%d') AS date, 'u' || user_id AS author, 'a' || event_id || '.py' AS file FROM events")
def commit_log(spark, sf_dir):
    """Commits from the text of a log."""
    log = F.expr(r"concat('\u001e', 'h', event_id, '\u001f', event_type, '\u001f', date_format(ts, 'yyyy-MM-dd'), '\u001f', 'u', user_id, '\n', 'a', event_id, '.py\n\n')")
    rows = table(spark, sf_dir, "events").select(F.inline(parsed_log(log)))
    return rows.select("hash", "subject", "date", "author", F.explode("files").alias("file"))


@query_of("SELECT 'm' || p_partkey || '.py' AS file, unnest(['f' || p_partkey, 'K', 'K.go']) AS qualname, unnest(['function', 'class', 'function']) AS kind, unnest([2, 4, 5]) AS lineno, unnest(['g' || p_size, '', 'f' || p_partkey || ',h']) AS calls FROM part")
def python_syntax(spark, sf_dir):
    """Symbols, lines and calls of Python sources."""
    text = F.expr(r"concat('import os\ndef f', p_partkey, '():\n    return g', p_size, '(1)\nclass K:\n    def go(self):\n        f', p_partkey, '(self.h())\n')")
    corpus = table(spark, sf_dir, "part").select(F.expr("concat('m', p_partkey, '.py')").alias("path"), F.lit(".py").alias("ext"), text.alias("text"))
    rows = build.symbol_rows(parsed(corpus))
    return rows.select("file", "qualname", "kind", "lineno", F.array_join("calls", ",").alias("calls"))


def focus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: seeds, personalised ranking, costs and the budget."""
    return _QUERIES["focus"](spark, sf_dir)
