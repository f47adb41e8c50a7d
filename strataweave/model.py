"""The typed property graph: vocabularies, schemas and the pair of DataFrames that hold it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

KINDS = ("file", "symbol", "area", "decision", "session")
CATEGORIES = ("structure", "doc", "code", "config", "data", "memory")
#: How much relevance an edge of each type carries; other types carry OTHER_WEIGHT.
EDGE_WEIGHTS = {"belongs_to": 0.15, "touches": 0.3, "mentions": 0.6, "references": 0.8, "calls": 1.0, "imports": 1.0, "defines": 1.0}
OTHER_WEIGHT = 0.5
#: Edges along which a change spreads, and those that make one file need another.
SPREADING = ("calls", "defines", "imports", "references")
NEEDING = ("calls", "imports", "references")
LAYERS = tuple("entrypoint api service core data ui util tests config docs other".split())
KIND_COLOURS = {"area": "#ef6c00", "decision": "#8e24aa", "file": "#1e66b4", "session": "#78909c", "symbol": "#2e8b57"}
EDGE_COLOURS = {"belongs_to": "#b0bec5", "calls": "#2e8b57", "defines": "#4db6ac", "imports": "#1e66b4", "mentions": "#8e24aa", "references": "#ef6c00", "touches": "#90a4ae"}
ROOT_AREA = "(root)"

NODE_SCHEMA = (
    "id string, kind string, label string, path string, category string, description string, size bigint, line int, symbol string, "
    "date string, author string, subject string, broken_refs array<string>, extra map<string,string>"
)
NODE_COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
EDGE_SCHEMA = "src string, dst string, type string, meta map<string,string>"
EDGE_COLUMNS = ["src", "dst", "type", "meta"]
MANIFEST_SCHEMA = "path string, sig string"


def nodes_frame(rows: DataFrame) -> DataFrame:
    """The rows with every node column; those that are missing are null."""
    types = dict(c.split(" ", 1) for c in NODE_SCHEMA.split(", "))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in NODE_COLUMNS])


def edges_frame(rows: DataFrame) -> DataFrame:
    meta = F.col("meta") if "meta" in rows.columns else F.lit(None)
    return rows.select("src", "dst", "type", meta.cast("map<string,string>").alias("meta"))


def edge_weight(kind: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, w in EDGE_WEIGHTS.items():
        out = F.when(kind == name, F.lit(w)).otherwise(out)
    return out


@dataclass(frozen=True)
class Graph:
    """nodes are unique by id, edges by (src, dst, type). Ends of edges need not be nodes."""

    nodes: DataFrame
    edges: DataFrame
    project: str = "project"

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def stored(self) -> Graph:
        """The same graph, written to the checkpoint folder: queries that go over it many times plan and run on files instead of all that made it."""
        from .operators.rank import written

        return Graph(written(self.nodes), written(self.edges), self.project)

    def cache(self) -> Graph:
        return Graph(self.nodes.persist(), self.edges.persist(), self.project)

    def unpersist(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()


def graph_of(nodes: DataFrame, edges: DataFrame, project: str = "project", seq: str | None = None) -> Graph:
    """A graph from rows that may repeat keys. With seq, the row of the least seq stays; without, any."""
    if seq is None:
        return Graph(nodes_frame(nodes.dropDuplicates(["id"])), edges_frame(edges.dropDuplicates(["src", "dst", "type"])), project)
    others = [c for c in nodes.columns if c not in ("id", seq)]
    first = nodes.groupBy("id").agg(F.min_by(F.struct(*others), F.col(seq)).alias("n")).select("id", "n.*")
    return Graph(nodes_frame(first), edges_frame(edges.dropDuplicates(["src", "dst", "type"])), project)


def without_strays(graph: Graph) -> DataFrame:
    """The edges whose ends are both nodes."""
    ids = graph.nodes.select("id")
    return graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*EDGE_COLUMNS)
