"""Graphs in formats that other tools read. Rows are made by Spark in their canonical order; a single document is assembled from a sorted stream of them."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import layer
from ..functions.paths import top_area
from ..model import EDGE_COLOURS, KIND_COLOURS, SCHEMA_VERSION, Graph
from .graph import degrees
from .rank import pagerank

FORMATS = ("dot", "jgf", "native")
GENERATOR = "strataweave"


def _meta() -> Column:
    """The facts of a node as JSON, null ones left out."""
    own = F.to_json(F.struct("size", "line", "symbol", "date", "author", "subject", "broken_refs"), {"ignoreNullFields": "true"})
    more = F.to_json(F.coalesce("extra", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    both = F.concat(F.substring(own, F.lit(1), F.char_length(own) - 1), F.lit(","), F.substring(more, F.lit(2), F.char_length(more)))
    return F.when(more == "{}", own).when(own == "{}", more).otherwise(both)


def native_nodes(graph: Graph) -> DataFrame:
    """id and the node as JSON."""
    head = F.to_json(F.struct("id", "kind", "label", "path", "category", F.coalesce("description", F.lit("")).alias("description")), {"ignoreNullFields": "false"})
    return graph.nodes.select("id", F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit(',"meta":'), _meta(), F.lit("}")).alias("json"))


def native_edges(graph: Graph) -> DataFrame:
    meta = F.coalesce(F.to_json("meta"), F.lit("{}"))
    head = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "type"))
    return graph.edges.select("src", "dst", "type", F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit(',"meta":'), meta, F.lit("}")).alias("json"))


def _sorted(rows: DataFrame, column: str, *by: str) -> Iterator[str]:
    for r in rows.orderBy(*by).select(column).toLocalIterator(prefetchPartitions=True):
        yield r[0]


def to_native(graph: Graph) -> str:
    """The canonical document: nodes by id, edges by source, target and type."""
    head = json.dumps({"schema_version": SCHEMA_VERSION, "project": graph.project}, ensure_ascii=False)[:-1]
    return f'{head}, "nodes": [{",".join(_sorted(native_nodes(graph), "json", "id"))}], "edges": [{",".join(_sorted(native_edges(graph), "json", "src", "dst", "type"))}]}}'


def jgf_nodes(graph: Graph) -> DataFrame:
    """id, label and the metadata of JSON Graph Format as JSON."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    facts = F.to_json(F.struct("kind", blank("category"), blank("path"), blank("description"), "size", "line", "symbol", "date", "author", "subject", "broken_refs"), {"ignoreNullFields": "true"})
    return graph.nodes.select("id", "label", facts.alias("facts"))


def to_jgf(graph: Graph) -> str:
    nodes = jgf_nodes(graph).orderBy("id").toLocalIterator(prefetchPartitions=True)
    edges = graph.edges.orderBy("src", "dst", "type").toLocalIterator(prefetchPartitions=True)
    entry = lambda e: {"source": e["src"], "target": e["dst"], "relation": e["type"], **({"metadata": e["meta"]} if e["meta"] else {})}
    whole = dict(directed=True, label=graph.project, metadata=dict(generator=GENERATOR, schema_version=SCHEMA_VERSION), nodes={n["id"]: {"label": n["label"], "metadata": json.loads(n["facts"])} for n in nodes}, edges=[entry(e) for e in edges])
    return json.dumps({"graph": whole}, ensure_ascii=False, indent=2)


def dot_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(graph: Graph) -> DataFrame:
    """part (1 nodes, 2 edges), a, b, c (their order) and line."""
    colour = F.lit("#9aa4b2")
    for kind, hue in KIND_COLOURS.items():
        colour = F.when(F.col("kind") == kind, F.lit(hue)).otherwise(colour)
    node = F.concat(F.lit("  "), dot_quoted(F.col("id")), F.lit(" [label="), dot_quoted(F.col("label")), F.lit(", fillcolor="), dot_quoted(colour), F.lit(", fontcolor=white];"))
    edge = F.concat(F.lit("  "), dot_quoted(F.col("src")), F.lit(" -> "), dot_quoted(F.col("dst")), F.lit(" [label="), dot_quoted(F.col("type")), F.lit("];"))
    rows = graph.nodes.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), node.alias("line"))
    return rows.union(graph.edges.select(F.lit(2), "src", "dst", "type", edge))


def to_dot(graph: Graph) -> str:
    name = "".join("\\" + c if c in "\\\"" else c for c in graph.project)
    lines = _sorted(dot_lines(graph), "line", "part", "a", "b", "c")
    return "\n".join([f'digraph "{name}" {{', "  rankdir=LR;", "  node [fontsize=10, shape=ellipse, style=filled];", *lines, "}"])


def write_parts(graph: Graph, form: str, folder: str) -> None:
    """Text files whose lines, read in the order of their names, are the sorted rows of the format: for graphs too large for one document. Nothing passes the driver."""
    rows = {
        "dot": lambda: dot_lines(graph).orderBy("part", "a", "b", "c").select("line"),
        "native": lambda: native_nodes(graph).select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), "json").union(native_edges(graph).select(F.lit(2), "src", "dst", "type", "json")).orderBy("part", "a", "b", "c").select("json"),
    }
    if form not in rows:
        raise ValueError(f"{form!r} isn't written in parts; {' and '.join(rows)} are")
    rows[form]().write.text(folder)


def export(graph: Graph, form: str) -> str:
    made = {"dot": to_dot, "jgf": to_jgf, "native": to_native}
    if form not in made:
        raise ValueError(f"no such format: {form!r}; there are {', '.join(FORMATS)}")
    return made[form](graph)


def view_nodes(graph: Graph, strategy: str = "distributed") -> DataFrame:
    """What a viewer draws: id, kind, label, path, deg, score, area, layer."""
    path = F.coalesce("path", F.lit(""))
    rows = graph.nodes.join(degrees(graph), "id").join(pagerank(graph, strategy=strategy), "id", "left")
    return rows.select("id", "kind", "label", path.alias("path"), "deg", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), top_area(path).alias("area"), layer(F.col("kind"), F.col("path"), F.col("category")).alias("layer"))


def view_payload(graph: Graph, strategy: str = "distributed") -> dict:
    edges = graph.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type").orderBy("source", "target", "type")
    return {"project": graph.project, "nodes": [r.asDict() for r in view_nodes(graph, strategy).orderBy("id").collect()], "links": [r.asDict() for r in edges.collect()], "nodeColors": KIND_COLOURS, "edgeColors": EDGE_COLOURS}


PAGE = """<!doctype html><meta charset="utf-8"><title>graph</title><style>body{margin:0;font:13px sans-serif}canvas{display:block;width:100vw;height:100vh}#q{position:fixed;top:8px;left:8px}</style>
<input id="q" placeholder="search"><canvas id="c"></canvas><script type="application/json" id="d">%s</script><script>
const d=JSON.parse(document.getElementById('d').textContent),c=document.getElementById('c'),x=c.getContext('2d'),q=document.getElementById('q');
const m=new Map(),top_=Math.max(1e-12,...d.nodes.map(n=>n.score));d.nodes.forEach((n,i)=>{const a=i*2.399963,r=12*Math.sqrt(i);n.x=r*Math.cos(a);n.y=r*Math.sin(a);m.set(n.id,n)});
function draw(){c.width=innerWidth;c.height=innerHeight;x.translate(c.width/2,c.height/2);const s=.45*Math.min(c.width,c.height)/(12*Math.sqrt(d.nodes.length)+1);x.scale(s,s);
for(const l of d.links){const a=m.get(l.source),b=m.get(l.target);if(a&&b){x.strokeStyle=d.edgeColors[l.type]||'#ccc';x.beginPath();x.moveTo(a.x,a.y);x.lineTo(b.x,b.y);x.stroke()}}
const w=q.value.toLowerCase();for(const n of d.nodes){x.globalAlpha=!w||n.id.toLowerCase().includes(w)?1:.15;x.fillStyle=d.nodeColors[n.kind]||'#999';x.beginPath();x.arc(n.x,n.y,2+8*Math.sqrt(n.score/top_),0,7);x.fill();if(n.score>.3*top_)x.fillText(n.label,n.x+8,n.y)}}
addEventListener('resize',draw);q.oninput=draw;draw()</script>"""


def render_view(graph: Graph, strategy: str = "distributed") -> str:
    """A page that needs no network. Every < of the data is escaped, so no name can end the script that holds it."""
    data = json.dumps(view_payload(graph, strategy), ensure_ascii=False)
    return PAGE.replace("%s", "\\u003c".join(data.split("<")))
