"""The queries as tools of a long-lived session: for assistants, notebooks, or programs that talk in lines of JSON.

The stored graph is loaded once and again when another version was stored. Sources are only read.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import SparkSession

from .model import Graph
from .plans import gate, query
from .plans.build import index
from .sources import store
from .sources.files import read_corpus

Answer = dict[str, Any]
TOOLS = ("project_map", "focus", "impact", "find", "neighbors", "why", "tour", "health")


class Service:
    """One method for each tool. strategy is that of the ranking: a project folder is small, so by default it runs on the driver."""

    def __init__(self, spark: SparkSession, root: str, strategy: str = "local"):
        self.spark, self.root, self.strategy = spark, root, strategy
        self._version: str | None = None
        self._graph: Graph | None = None

    def graph(self) -> Graph:
        """The stored graph, or, if there is none, one built now."""
        version = store.current_version(self.spark, self.root)
        if self._graph is None or version != self._version:
            if self._graph is not None:
                self._graph.unpersist()
            self._graph = (store.load_graph(self.spark, self.root) or index(self.spark, self.root)[0]).cache()
            self._version = version
        return self._graph

    def project_map(self, top: int = 8) -> Answer:
        """A ranked digest of the project; the first thing to read."""
        return query.project_map(self.graph(), top, self.strategy)

    def focus(self, task: str, budget: int = 1500) -> Answer:
        """The smallest subgraph that matters for a task, a file or a symbol."""
        return query.focus(self.graph(), task, budget, self.strategy)

    def impact(self, seed: str, budget: int = 1500, dependencies: bool = False, hops: int | None = None) -> Answer:
        """What a change of the seed reaches or, the other way round, what the seed relies on."""
        return query.impact(self.graph(), seed, None, budget, query.DEPENDENCIES if dependencies else query.DEPENDENTS, hops, self.strategy)

    def find(self, text: str, limit: int = 25) -> list[Answer]:
        """Nodes whose name, path or id holds the text."""
        return [r.asDict() for r in query.find(self.graph(), text, limit).collect()]

    def neighbors(self, node_id: str) -> Answer:
        """A node and its typed connections."""
        return query.neighbors(self.graph(), node_id) or {"error": "no such node", "id": node_id}

    def why(self, a: str, b: str) -> Answer:
        """The shortest chain of typed edges between two nodes."""
        return query.why(self.graph(), a, b, self.strategy)

    def tour(self, budget: int = 2000) -> Answer:
        """The most important files, those that others need first."""
        return query.tour(self.graph(), budget, strategy=self.strategy)

    def health(self) -> Answer:
        """Broken links, files that differ from the last build, and orphans."""
        old = store.load_manifest(self.spark, self.root)
        if old is None:
            return {"status": "nothing is stored yet"}
        return gate.drift(self.graph(), old, gate.manifest_of(read_corpus(self.spark, self.root))).facts()

    def call(self, tool: str, arguments: Answer | None = None) -> Any:
        """Runs a tool by its name; ValueError if there is none, or its arguments don't fit."""
        if tool not in TOOLS:
            raise ValueError(f"no such tool: {tool}; there are {', '.join(TOOLS)}")
        method = getattr(self, tool)
        try:
            bound = inspect.signature(method).bind(**(arguments or {}))
        except TypeError as e:
            raise ValueError(f"{tool}: {e}") from None
        return method(*bound.args, **bound.kwargs)


def described() -> list[Answer]:
    """The tools with what they do and take."""
    kind = lambda p: {"type": str(p.annotation), **({} if p.default is p.empty else {"default": p.default})}
    return [{"tool": t, "does": inspect.getdoc(f), "takes": {k: kind(p) for k, p in inspect.signature(f).parameters.items() if k != "self"}} for t in TOOLS for f in [getattr(Service, t)]]


def serve(service: Service, lines: Iterable[str]) -> Iterator[str]:
    """An answer in JSON for each line {"tool": ..., "arguments": {...}}; the tool `tools` describes them all. A wrong line gives an error and no end."""
    for line in lines:
        if not line.strip():
            continue
        try:
            asked = json.loads(line)
            if not isinstance(asked, dict):
                raise ValueError("a line must be a JSON object")
            answer = {"result": described() if asked.get("tool") == "tools" else service.call(str(asked.get("tool")), asked.get("arguments"))}
        except ValueError as e:
            answer = {"error": str(e)}
        yield json.dumps(answer, ensure_ascii=False)
