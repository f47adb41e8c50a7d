"""The ranked, budgeted queries over a graph. Tables stay DataFrames; what a reader gets is small and comes as plain values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import layer
from ..functions.paths import top_area
from ..functions.tokens import estimated
from ..model import LAYERS, Graph
from ..operators import graph as g
from ..operators.budget import within_budget
from ..operators.rank import pagerank, top_ranked
from ..operators.traverse import expanded, file_needs, reach, reading_order, resolve_one, resolve_seeds, shortest_path, steps

DEPENDENTS, DEPENDENCIES = "dependents", "dependencies"
Answer = dict[str, Any]


def area_digest(graph: Graph, top: int | None = 8) -> DataFrame:
    """area, files, size, top_cats (three of the most files) of the largest areas."""
    files = graph.nodes.where("kind = 'file'").select(top_area(F.coalesce("path", F.lit(""))).alias("area"), F.coalesce("category", F.lit("?")).alias("cat"), F.coalesce("size", F.lit(0)).alias("size"))
    per = files.groupBy("area", "cat").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    cats = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "cat"))), lambda c: c["cat"]), 1, 3)
    out = per.groupBy("area").agg(F.sum("n").alias("files"), F.sum("size").alias("size"), cats.alias("top_cats"))
    return out if top is None else out.orderBy(F.desc("size"), "area").limit(top)


def layer_summary(graph: Graph) -> DataFrame:
    """layer, files, size in the order of LAYERS."""
    files = graph.nodes.where("kind = 'file'").select(layer(F.col("kind"), F.col("path"), F.col("category")).alias("layer"), F.coalesce("size", F.lit(0)).alias("size"))
    place = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    return files.groupBy("layer").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size")).orderBy(place)


def project_map(graph: Graph, top: int = 8, strategy: str = "distributed") -> Answer:
    """The digest of a project."""
    n = g.counts(graph).collect()
    kinds, types = ({r["name"]: r["n"] for r in n if r["what"] == w} for w in ("node", "edge"))
    files = graph.nodes.where("kind = 'file'")
    whole = files.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.countDistinct(top_area(F.coalesce("path", F.lit("")))).alias("areas")).first()
    broken = graph.nodes.agg(F.sum(F.greatest(F.size(F.coalesce("broken_refs", F.array().cast("array<string>"))), F.lit(0))).alias("n")).first()["n"]
    best = top_ranked(graph, ranking(graph, strategy=strategy), limit=top).join(graph.nodes.select("id", "kind"), "id").orderBy(F.desc("score"), "id")
    return {
        "project": graph.project, "files": whole["files"], "symbols": kinds.get("symbol", 0), "areas": whole["areas"], "edges": sum(types.values()), "size": whole["size"] or 0, "node_kinds": kinds, "edge_types": types,
        "by_area": [r.asDict() for r in area_digest(graph, top).collect()], "by_layer": [r.asDict() for r in layer_summary(graph).collect()],
        "most_important": [{"id": r["id"], "kind": r["kind"], "score": round(r["score"], 5)} for r in best.collect()], "orphans": g.orphans(graph).count(), "broken_refs": broken or 0,
    }


def find(graph: Graph, query: str, limit: int = 25) -> DataFrame:
    """id, kind, path of the nodes, areas aside, whose label, path or id holds the query, by id; a blank query finds nothing."""
    q = query.strip().lower()
    hit = F.lower("label").contains(q) | F.coalesce(F.lower("path").contains(q), F.lit(False)) | F.lower("id").contains(q)
    return graph.nodes.where((F.col("kind") != "area") & hit & F.lit(bool(q))).select("id", "kind", "path").orderBy("id").limit(limit)


def neighbour_rows(graph: Graph, node_id: str) -> DataFrame:
    """dir (out or in), id, kind ('?' where the other end is no node), edge."""
    out = graph.edges.where(F.col("src") == node_id).select(F.lit("out").alias("dir"), F.col("dst").alias("id"), F.col("type").alias("edge"))
    back = graph.edges.where(F.col("dst") == node_id).select(F.lit("in").alias("dir"), F.col("src").alias("id"), F.col("type").alias("edge"))
    return out.union(back).join(graph.nodes.select("id", "kind"), "id", "left").select("dir", "id", F.coalesce("kind", F.lit("?")).alias("kind"), "edge")


def neighbors(graph: Graph, of: str) -> Answer | None:
    """A node and its typed connections; None if there is no such node."""
    node = graph.nodes.where(F.col("id") == of).first()
    if node is None:
        return None
    rows = neighbour_rows(graph, of).orderBy("id", "edge").collect()
    side = lambda d: [{"id": r["id"], "kind": r["kind"], "edge": r["edge"]} for r in rows if r["dir"] == d]
    return {"id": node["id"], "kind": node["kind"], "path": node["path"], "size": node["size"] or 0, "description": node["description"], "broken_refs": node["broken_refs"] or [], "outgoing": side("out"), "incoming": side("in")}


def _answer(rows: list, columns: list[str]) -> list[Answer]:
    return [{c: r[c] for c in columns if c in ("id", "kind", "deg", "score", "dist") or r[c] is not None} for r in rows]


def _edges_of(graph: Graph, ids: list[str]) -> list[dict[str, str]]:
    few = g.induced_edges(graph, graph.spark.createDataFrame([(i,) for i in ids], "id string"))
    return [{"source": r["src"], "target": r["dst"], "type": r["type"]} for r in few.orderBy("src", "dst", "type").collect()]


def ranking(graph: Graph, seeds: DataFrame | None = None, strategy: str = "distributed") -> DataFrame:
    """id, score to twelve digits, so that what is equal ties in whatever order it was added up."""
    return pagerank(graph, seeds, strategy=strategy).withColumn("score", F.round("score", 12))


def focus_rows(graph: Graph, seeds: list[str], budget: int = 1500, strategy: str = "distributed") -> DataFrame:
    """The rows of the personalised ranking that fit the budget."""
    given = graph.spark.createDataFrame([(s, 1.0) for s in seeds], "id string, weight double")
    return within_budget(graph, ranking(graph, given, strategy), budget)


def focus(graph: Graph, query: str, budget: int = 1500, strategy: str = "distributed") -> Answer:
    """The smallest subgraph that matters for a task, a path or an id, within a budget of tokens."""
    seeds = resolve_seeds(graph, query)
    out: Answer = dict(query=query, seeds=seeds[:10], budget_tokens=budget, used_tokens=0, nodes=[], edges=[])
    if not seeds:
        return out | {"note": "no node matches the query"}
    rows = focus_rows(graph, seeds, budget, strategy).orderBy("rank").withColumn("score", F.round("score", 5)).collect()
    return out | {"used_tokens": rows[-1]["used"], "nodes": _answer(rows, ["id", "kind", "cat", "size", "line", "deg", "score"]), "edges": _edges_of(graph, [r["id"] for r in rows])}


def affected(graph: Graph, seeds: list[str], direction: str = DEPENDENTS, hops: int | None = None, strategy: str = "distributed") -> DataFrame:
    """id, dist (1 or more) of what a change of the seeds reaches, or what they rely on."""
    start = expanded(graph, graph.spark.createDataFrame([(s,) for s in seeds], "id string"))
    return reach(graph, start, direction == DEPENDENTS, hops, strategy=strategy).where("dist > 0")


def impact_rows(graph: Graph, hit: DataFrame, budget: int = 1500, strategy: str = "distributed") -> DataFrame:
    """The affected nodes by a ranking that restarts near the seeds, as far as the budget goes."""
    scores = ranking(graph, hit.select("id", (1.0 / (1 + F.col("dist"))).alias("weight")), strategy)
    return within_budget(graph, scores.join(hit.select("id"), "id", "left_semi"), budget).join(hit, "id")


def impact(graph: Graph, query: str = "", seed_ids: list[str] | None = None, budget: int = 1500, direction: str = DEPENDENTS, hops: int | None = None, strategy: str = "distributed") -> Answer:
    """The blast radius of a change. Seeds are the ids given, else those that match the query."""
    seeds = [s for s in dict.fromkeys(seed_ids) if g.has_node(graph, s)] if seed_ids is not None else resolve_seeds(graph, query, 10)
    out: Answer = dict(query=query, seeds=seeds[:10], direction=direction, hops=hops, budget_tokens=budget, used_tokens=0, total_affected=0, nodes=[], edges=[])
    if not seeds:
        return out | {"note": "no node matches the seed"}
    hit = affected(graph, seeds, direction, hops, strategy).persist()
    try:
        total = hit.count()
        if not total:
            return out | {"note": "the change reaches nothing else"}
        rows = impact_rows(graph, hit, budget, strategy).orderBy("rank").withColumn("score", F.round("score", 5)).collect()
    finally:
        hit.unpersist()
    return out | {"total_affected": total, "used_tokens": rows[-1]["used"], "nodes": _answer(rows, ["id", "kind", "cat", "size", "line", "deg", "dist", "score"]), "edges": _edges_of(graph, [r["id"] for r in rows])}


def why(graph: Graph, a: str, b: str, strategy: str = "distributed") -> Answer:
    """How two nodes are connected: the shortest chain of typed edges between them."""
    ends = [resolve_one(graph, a), resolve_one(graph, b)]
    out: Answer = dict(a=a, b=b, resolved=ends, found=False, length=0, path=[])
    if None in ends:
        return out | {"note": "an endpoint matches no node"}
    path = shortest_path(graph, *ends, strategy)
    if not path:
        return out | {"note": "nothing connects the endpoints"}
    rows = steps(graph, path).collect()
    chain = [{"id": r["id"], "kind": r["kind"], **({"edge": r["edge"], "dir": r["dir"]} if k else {})} for k, r in enumerate(rows)]
    return out | {"found": True, "length": len(path) - 1, "path": chain}


def tour_stops(graph: Graph, budget: int = 2000, max_stops: int = 40, strategy: str = "distributed") -> DataFrame:
    """step, id, layer, score, uses, used_by, used: the most important files, what they need before them, as far as the budget goes.

    The order depends on at most max_stops files, and is worked out over them alone.
    """
    best = top_ranked(graph, ranking(graph, strategy=strategy), "file", max_stops).collect()
    spark, score = graph.spark, {r["id"]: r["score"] for r in best}
    files = spark.createDataFrame([(i,) for i in score], "id string")
    needs = [(r["u"], r["v"]) for r in file_needs(graph, files).collect()]
    order = reading_order(list(score.items()), needs)
    most = lambda ids: sorted(ids, key=lambda x: (-score[x], x))[:3]
    rows = [(k + 1, i, score[i], most([v for u, v in needs if u == i]), most([u for u, v in needs if v == i])) for k, i in enumerate(order)]
    stops = spark.createDataFrame(rows, "step int, id string, score double, uses array<string>, used_by array<string>")
    cost = estimated(F.concat_ws(" ", F.col("id"), F.array_join("uses", " "), F.array_join("used_by", " ")))
    stops = stops.withColumn("used", F.sum(cost).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))).where((F.col("step") == 1) | (F.col("used") <= budget))
    facts = graph.nodes.join(F.broadcast(files), "id", "left_semi").select("id", layer(F.col("kind"), F.col("path"), F.col("category")).alias("layer"))
    return stops.join(facts, "id").select("step", "id", "layer", F.round("score", 5).alias("score"), "uses", "used_by", "used")


def tour(graph: Graph, budget: int = 2000, max_stops: int = 40, strategy: str = "distributed") -> Answer:
    rows = tour_stops(graph, budget, max_stops, strategy).orderBy("step").collect()
    total = min(max_stops, graph.nodes.where("kind = 'file'").limit(max_stops).count())
    return {"project": graph.project, "stops": [{c: r[c] for c in ("step", "id", "layer", "score", "uses", "used_by")} for r in rows], "total_files": total, "used_tokens": rows[-1]["used"] if rows else 0, "budget_tokens": budget}
