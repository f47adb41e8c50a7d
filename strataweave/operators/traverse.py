"""Seeds, typed reachability, shortest paths and reading orders.

Reachability and paths take a join and an anti-join a level, and each level goes to the checkpoint folder. As in ``rank``,
``strategy="local"`` gives the same from arrays on the driver, for callers who know that their graph is small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import NEEDING, SPREADING, Graph
from .graph import degrees_of, has_node
from .rank import LocalGraph, ready


def seed_hits(query: str, node_id: Column, label: Column) -> Column:
    """3 if id and label hold the whole phrase, else how many of its words (over a character long) they hold."""
    low = query.strip().lower()
    hay = F.lower(F.concat(node_id, F.lit(" "), label))
    words = [w for w in low.translate(str.maketrans("/.", "  ")).split() if len(w) > 1]
    some = sum((hay.contains(w).cast("int") for w in words), F.lit(0))
    return F.when(hay.contains(low), F.lit(3)).otherwise(some)


def seed_scores(graph: Graph, query: str) -> DataFrame:
    """id, score of the nodes, areas aside, that match the query at all: 100 for each hit, and the degree."""
    hit = graph.nodes.where("kind <> 'area'").select("id", seed_hits(query, F.col("id"), F.col("label")).alias("hits")).where("hits > 0")
    return hit.join(degrees_of(graph, hit), "id").select("id", (F.col("hits") * 100 + F.col("deg")).cast("long").alias("score"))


def resolve_seeds(graph: Graph, query: str, most: int = 25) -> list[str]:
    """The query itself if it is an id, else the best-matching ids."""
    if has_node(graph, query.strip()):
        return [query.strip()]
    return [r["id"] for r in seed_scores(graph, query).orderBy(F.desc("score"), "id").limit(most).collect()]


def resolve_one(graph: Graph, query: str) -> str | None:
    """An exact id as it is written, else the best match."""
    if has_node(graph, query):
        return query
    return next(iter(resolve_seeds(graph, query, 1)), None)


def expanded(graph: Graph, seeds: DataFrame) -> DataFrame:
    """id: the seeds that are nodes, the symbols that seed files define, and the files of seed symbols."""
    known = graph.nodes.select("id", "kind").join(seeds.select("id").distinct(), "id", "left_semi")
    defines = graph.edges.where("type = 'defines'")
    down = defines.join(known.where("kind = 'file'").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    up = defines.join(known.where("kind = 'symbol'").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
    return known.select("id").union(down).union(up).distinct()


def reach(graph: Graph, seeds: DataFrame, dependents: bool = True, hops: int | None = None, types: tuple[str, ...] = SPREADING, strategy: str = "distributed") -> DataFrame:
    """id, dist: the fewest edges from a seed, against their direction for dependents; seeds have 0."""
    spark = ready(graph.spark)
    if strategy == "local":
        g = LocalGraph(graph)
        use = g.of_types(types)
        a, b = (g.dst[use], g.src[use]) if dependents else (g.src[use], g.dst[use])
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        before = np.searchsorted(a, np.arange(g.n + 1))
        dist = np.full(g.n, -1, np.int32)
        front = np.unique(g.places([r["id"] for r in seeds.select("id").distinct().collect()]))
        dist[front] = 0
        d = 0
        while len(front) and (hops is None or d < hops):
            d += 1
            size = before[front + 1] - before[front]
            near = b[np.repeat(before[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            front = np.unique(near[dist[near] < 0])
            dist[front] = d
        at = np.flatnonzero(dist >= 0)
        return spark.createDataFrame(pa.table({"id": g.ids.take(pa.array(at)), "dist": pa.array(dist[at])}))
    one, other = ("dst", "src") if dependents else ("src", "dst")
    links = graph.edges.where(F.col("type").isin(*types)).select(F.col(one).alias("id"), F.col(other).alias("to")).distinct().repartition("id").persist()
    front = graph.nodes.select("id").join(seeds.select("id").distinct(), "id", "left_semi").checkpoint()
    seen, d = front.withColumn("dist", F.lit(0)), 0
    while (hops is None or d < hops) and not front.isEmpty():
        d += 1
        front = links.join(front, "id", "left_semi").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").checkpoint()
        seen = seen.union(front.withColumn("dist", F.lit(d))).checkpoint() if d % 16 == 0 else seen.union(front.withColumn("dist", F.lit(d)))
    links.unpersist()
    return seen


def shortest_path(graph: Graph, a: str, b: str, strategy: str = "distributed") -> list[str]:
    """The ids of the shortest undirected path, the first of them in the order of their ids; [] if there is none."""
    ready(graph.spark)
    if a == b:
        return [a]
    if strategy == "local":
        g = LocalGraph(graph)
        ends = g.places([a]), g.places([b])
        if not len(ends[0]) or not len(ends[1]):
            return []
        src, dst = np.concatenate([g.src, g.dst]), np.concatenate([g.dst, g.src])
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        before = np.searchsorted(src, np.arange(g.n + 1))
        parent = np.full(g.n, -1, np.int64)
        parent[ends[0]] = ends[0]
        front = ends[0]
        while len(front) and parent[ends[1][0]] < 0:  # fronts stay in the order of their least paths
            size = before[front + 1] - before[front]
            near = dst[np.repeat(before[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            by = np.repeat(front, size)
            new = parent[near] < 0
            near, by = near[new], by[new]
            first = np.sort(np.unique(near, return_index=True)[1])
            front = near[first]
            parent[front] = by[first]
        at, path = int(ends[1][0]), []
        if parent[at] < 0:
            return []
        while at != ends[0][0]:
            path.append(at)
            at = int(parent[at])
        return [g.ids[int(k)].as_py() for k in [int(ends[0][0]), *path[::-1]]]
    links = graph.edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("id"), F.col("src").alias("to"))))).distinct().repartition("id").persist()
    front = graph.nodes.where(F.col("id") == a).select("id", F.array("id").alias("path")).checkpoint()
    seen = front.select("id")
    while True:
        found = front.where(F.col("id") == b).select("path").collect()
        if found or front.isEmpty():
            links.unpersist()
            return list(found[0]["path"]) if found else []
        near = links.join(front, "id").groupBy(F.col("to").alias("id")).agg(F.min("path").alias("path")).join(seen, "id", "left_anti")
        front = near.select("id", F.concat("path", F.array("id")).alias("path")).checkpoint()
        seen = seen.union(front.select("id"))


def steps(graph: Graph, path: list[str]) -> DataFrame:
    """step, id, kind, edge and dir of each node of a path: the type that links it with the node before and whether it points there (->) or back (<-)."""
    spark = graph.spark
    hops = spark.createDataFrame([(k, path[k - 1] if k else None, x) for k, x in enumerate(path)], "step int, prev string, id string")
    edge = graph.edges.groupBy("src", "dst").agg(F.min("type").alias("type"))
    forth = edge.select(F.col("src").alias("prev"), F.col("dst").alias("id"), F.col("type").alias("forth"))
    back = edge.select(F.col("dst").alias("prev"), F.col("src").alias("id"), F.col("type").alias("back"))
    out = hops.join(graph.nodes.select("id", "kind"), "id", "left").join(forth, ["prev", "id"], "left").join(back, ["prev", "id"], "left")
    first = F.col("prev").isNull()
    return out.select(
        "step", "id", "kind", F.when(~first, F.coalesce("forth", "back", F.lit("?"))).alias("edge"), F.when(~first, F.when(F.col("forth").isNotNull(), "->").when(F.col("back").isNotNull(), "<-").otherwise("-")).alias("dir")
    ).orderBy("step")


def file_needs(graph: Graph, files: DataFrame) -> DataFrame:
    """u, v: file u of the given ones needs file v of them; symbols count as their files."""
    owner = graph.nodes.where("kind = 'symbol' and coalesce(path, '') <> ''").select("id", "path")
    edges = graph.edges.where(F.col("type").isin(*NEEDING)).select("src", "dst")
    for end, name in (("src", "u"), ("dst", "v")):
        edges = edges.join(owner.select(F.col("id").alias(end), F.col("path").alias(f"{name}_path")), end, "left").withColumn(name, F.coalesce(f"{name}_path", end))
    keep = F.broadcast(files.select("id"))
    edges = edges.select("u", "v").where("u <> v").join(keep.withColumnRenamed("id", "u"), "u", "left_semi").join(keep.withColumnRenamed("id", "v"), "v", "left_semi")
    return edges.select("u", "v").distinct()


def reading_order(files: list[tuple[str, float]], needs: list[tuple[str, str]]) -> list[str]:
    """What is needed first comes first; among what is ready, or in a cycle among all, the highest (score, id)."""
    waits = {f: set() for f, _ in files}
    for u, v in needs:
        waits[u].add(v)
    left, done = dict(files), []
    while left:
        able = [f for f in left if not waits[f] & left.keys()] or list(left)
        done.append(max(able, key=lambda f: (left[f], f)))
        del left[done[-1]]
    return done
