"""Stored graphs: Parquet for Spark, and the canonical JSON document for other tools.

A version is written as a whole into a folder of its own and then named in a pointer file with the next number, which is renamed
into its place. Pointers aren't overwritten, and the latest counts: readers see the old graph or the new one, never a
mixture. All of it goes through the file system of the folder, be it local or the cluster's.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CATEGORIES, EDGE_WEIGHTS, KINDS, SCHEMA_VERSION, Graph, edges_frame, graph_of, nodes_frame

FOLDER = ".strataweave"
POINTER = "current-"
_KNOWN = ("size", "line", "symbol", "date", "author", "subject", "broken_refs")


def write_whole(path: Path, text: str) -> None:
    """Replaces a file in one step."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w", newline="\n", encoding="utf-8") as f:
        f.write(text)
    os.replace(name, path)


def _files(spark: SparkSession, path: str):
    """The file system of a folder (local, or whatever the cluster has) and the folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def save(root: str, graph: Graph, manifest: DataFrame) -> str:
    """Writes graph and manifest, then the pointer; returns the folder of this version."""
    spark, home = graph.spark, f"{root}/{FOLDER}"
    name = f"v-{uuid.uuid4().hex}"
    graph.nodes.write.parquet(f"{home}/{name}/nodes")
    graph.edges.write.parquet(f"{home}/{name}/edges")
    manifest.write.parquet(f"{home}/{name}/manifest")
    fs, folder = _files(spark, home)
    old = [p for p, _ in _pointers(spark, root)]
    last = max((int(p.getName()[len(POINTER) :].split(".")[0]) for p in old), default=0)
    text = json.dumps({"version": name, "schema_version": SCHEMA_VERSION, "project": graph.project}, sort_keys=True)
    draft, final = (spark._jvm.org.apache.hadoop.fs.Path(folder, n) for n in (f"draft-{name}.json", f"{POINTER}{last + 1:012d}.json"))
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(draft, final):
        raise OSError(f"{final} is there already: another build ended just now")
    for p in old:
        fs.delete(p, False)
    return f"{home}/{name}"


def _pointers(spark: SparkSession, root: str) -> list:
    """(path, number) of the pointer files, the latest first."""
    fs, folder = _files(spark, f"{root}/{FOLDER}")
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    found = [(p, int(n)) for p in names if p.getName().startswith(POINTER) and (n := p.getName()[len(POINTER) :].removesuffix(".json")).isdigit()]
    return sorted(found, key=lambda x: -x[1])


def _current(spark: SparkSession, root: str) -> dict | None:
    """What the latest readable pointer says."""
    fs, _ = _files(spark, root)
    for path, _ in _pointers(spark, root):
        try:
            stream = fs.open(path)
            try:
                got = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        except (Py4JJavaError, ValueError):
            continue
        if isinstance(got, dict) and isinstance(got.get("version"), str):
            return got
    return None


def current_version(spark: SparkSession, root: str) -> str | None:
    now = _current(spark, root)
    return None if now is None else now["version"]


def load_graph(spark: SparkSession, root: str) -> Graph | None:
    """The stored graph; None if there is none, or it is damaged."""
    now = _current(spark, root)
    if now is None:
        return None
    at = f"{root}/{FOLDER}/{now['version']}"
    try:
        return Graph(nodes_frame(spark.read.parquet(f"{at}/nodes")), edges_frame(spark.read.parquet(f"{at}/edges")), now.get("project", "project"))
    except AnalysisException:
        return None


def load_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    now = _current(spark, root)
    if now is None:
        return None
    try:
        return spark.read.parquet(f"{root}/{FOLDER}/{now['version']}/manifest")
    except AnalysisException:
        return None


def load_or_build(spark: SparkSession, root: str) -> Graph:
    from ..plans.build import index

    return load_graph(spark, root) or index(spark, root)[0]


def graph_from_json(spark: SparkSession, path: str) -> Graph | None:
    """A graph from its JSON document. Unknown keys are ignored and known facts of nodes read from their meta; None if it can't be read or names unknown kinds."""
    node = "id string, kind string, label string, path string, category string, description string, meta map<string,string>"
    shape = f"schema_version int, project string, nodes array<struct<{node.replace(' string', ':string').replace(' map', ':map')}>>, edges array<struct<source:string,target:string,type:string,meta:map<string,string>>>"
    try:
        doc = spark.read.schema(shape).option("multiLine", True).json(path).persist()
        head = doc.first()
    except AnalysisException:
        return None
    if head is None or head["nodes"] is None:
        return None
    nodes = doc.select(F.posexplode("nodes").alias("seq", "n")).select("seq", "n.*")
    edges = doc.select(F.explode("edges").alias("e")).select(F.col("e.source").alias("src"), F.col("e.target").alias("dst"), F.col("e.type").alias("type"), F.col("e.meta").alias("meta"))
    wrong = nodes.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)) | ~F.coalesce(F.col("category").isin(*CATEGORIES), F.col("category").isNull()) | F.col("id").isNull() | F.col("label").isNull())
    if not wrong.isEmpty() or not edges.where(~F.coalesce(F.col("type").isin(*EDGE_WEIGHTS), F.lit(False))).isEmpty():
        return None
    meta = F.col("meta")
    facts = [meta[k].alias(k) for k in _KNOWN if k != "broken_refs"] + [F.from_json(meta["broken_refs"], "array<string>").alias("broken_refs")]
    rows = nodes.select("seq", "id", "kind", "label", "path", "category", F.coalesce("description", F.lit("")).alias("description"), *facts, F.map_filter(meta, lambda k, _: ~k.isin(*_KNOWN)).alias("extra"))
    return graph_of(rows, edges, head["project"] or "project", seq="seq")
