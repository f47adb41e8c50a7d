"""The best-ranked rows that fit a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import compact_row, estimated
from ..model import Graph
from .graph import degrees, degrees_of


def rows_with_cost(graph: Graph, ids: DataFrame | None = None) -> DataFrame:
    """id, kind, cat, size (files), line (symbols), deg and cost (the tokens of the row as JSON) of all nodes, or of some."""
    deg = degrees(graph) if ids is None else degrees_of(graph, ids)
    rows = graph.nodes.join(deg, "id").select(
        "id", "kind", F.col("category").alias("cat"), F.when(F.col("kind") == "file", F.coalesce("size", F.lit(0))).alias("size"), F.when((F.col("kind") == "symbol") & (F.col("line") != 0), F.col("line")).alias("line"), "deg"
    )
    return rows.withColumn("cost", estimated(compact_row(F.col("id"), F.col("kind"), F.col("cat"), F.col("size"), F.col("line"), F.col("deg"))))


def within_budget(graph: Graph, ranked: DataFrame, budget: int) -> DataFrame:
    """The rows of rows_with_cost and their score, best first, up to the first that would overflow; one at least.

    ranked has id and score. A row costs a token at least, so no more than budget + 1 of them, found by a
    distributed top-k, can matter: the running sum over one partition sees no more, however large the graph is.
    """
    best = ranked.join(graph.nodes.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(max(1, budget) + 1)
    rows = rows_with_cost(graph, best).join(best, "id")
    order = Window.orderBy(F.desc("score"), "id")
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("used", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("rank") == 1) | (F.col("used") <= budget))
