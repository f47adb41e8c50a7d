"""Primitives of the typed graph; every one is a plan over its nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_COLUMNS, Graph, edge_weight, without_strays


def has_node(graph: Graph, node_id: str) -> bool:
    return not graph.nodes.where(F.col("id") == node_id).select("id").limit(1).isEmpty()


def out_edges(graph: Graph, node_id: str) -> DataFrame:
    return graph.edges.where(F.col("src") == node_id).orderBy("dst", "type")


def in_edges(graph: Graph, node_id: str) -> DataFrame:
    return graph.edges.where(F.col("dst") == node_id).orderBy("src", "type")


def degrees(graph: Graph) -> DataFrame:
    """id, deg of every node: its edge ends, so that a loop counts twice and parallel edges count each."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return graph.nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("deg"))


def degrees_of(graph: Graph, ids: DataFrame) -> DataFrame:
    """id, deg of the given ids alone: edge ends are cut down to them before they are counted."""
    some = ids.select("id").distinct()
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).join(some, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return some.join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("deg"))


def neighbour_ids(graph: Graph, node_id: str) -> DataFrame:
    """Distinct ids at the other ends, whatever the direction; the node itself if it has a loop."""
    near = graph.edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))
    return near.select(F.when(F.col("src") == node_id, F.col("dst")).otherwise(F.col("src")).alias("id")).distinct()


def orphans(graph: Graph) -> DataFrame:
    """Files with no edges but those to their area."""
    used = graph.edges.where("type <> 'belongs_to'").select(F.explode(F.array("src", "dst")).alias("id"))
    return graph.nodes.where("kind = 'file'").select("id").join(used, "id", "left_anti")


def undirected_weights(graph: Graph) -> DataFrame:
    """a, b, w in both directions: the summed weights of the edges between two nodes; a loop counts twice."""
    half = without_strays(graph).select("src", "dst", edge_weight(F.col("type")).alias("w"))
    both = half.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), "w"), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), "w"))))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"))


def counts(graph: Graph) -> DataFrame:
    """what ('node' or 'edge'), name (its kind or type), n."""
    return graph.nodes.groupBy(F.lit("node").alias("what"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).union(graph.edges.groupBy(F.lit("edge"), F.col("type")).agg(F.count(F.lit(1))))


def induced_edges(graph: Graph, ids: DataFrame) -> DataFrame:
    """The edges with both ends among the ids (column id)."""
    keep = ids.select("id").distinct()
    return graph.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*EDGE_COLUMNS)


def induced_subgraph(graph: Graph, ids: DataFrame) -> Graph:
    """The graph of the given ids that are nodes, and the edges between them."""
    nodes = graph.nodes.join(ids.select("id").distinct(), "id", "left_semi")
    return Graph(nodes.select(graph.nodes.columns), induced_edges(graph, nodes), graph.project)


def backbone(graph: Graph, limit: int = 1500, scores: DataFrame | None = None, strategy: str = "distributed") -> Graph:
    """The limit nodes of the highest PageRank, and all areas."""
    from .rank import pagerank, top_ranked

    best = top_ranked(graph, pagerank(graph, strategy=strategy) if scores is None else scores, limit=limit).select("id")
    return induced_subgraph(graph, best.union(graph.nodes.where("kind = 'area'").select("id")))
