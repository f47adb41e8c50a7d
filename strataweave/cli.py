"""Commands over a project folder: build, stats, gate, map, find, neighbors, focus, impact, why, tour, view, watch, export, serve, doctor, install-hook.

A project folder is small, so rankings and paths run on the driver unless --strategy says distributed.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.tokens import human_size
from .operators import graph as g
from .operators.export import FORMATS, export, render_view
from .plans import gate, query
from .plans.build import index
from .doctor import examine
from .service import Service, serve
from .sources import store
from .sources.files import read_corpus
from .sources.history import changed_files
from .streaming.watch import install_hook, watch

VIEW_LIMIT = 1500


def _session() -> SparkSession:
    return SparkSession.builder.appName("strataweave").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple[str, dict]) -> None:
        one = commands.add_parser(name)
        for flag, options in flags:
            one.add_argument(flag, **options)
        one.add_argument("--root", default=".")
        one.add_argument("--json", action="store_true")
        one.add_argument("--strategy", choices=("local", "distributed"), default="local")

    budget = lambda n: ("--budget", {"type": int, "default": n})
    command("build")
    command("stats")
    command("gate")
    command("map", ("--top", {"type": int, "default": 8}))
    command("find", ("query", {}), ("--limit", {"type": int, "default": 25}))
    command("neighbors", ("id", {}))
    command("focus", ("query", {}), budget(1500))
    command("impact", ("query", {"nargs": "?"}), ("--diff", {"action": "store_true"}), ("--deps", {"action": "store_true"}), ("--hops", {"type": int}), budget(1500))
    command("why", ("a", {}), ("b", {}))
    command("tour", budget(2000), ("--stops", {"type": int, "default": 40}))
    command("view", ("--focus", {}), ("--out", {}))
    command("watch", ("--interval", {"type": float, "default": 2.0}))
    command("serve")
    command("doctor")
    command("install-hook")
    command("export", ("--format", {"choices": FORMATS, "default": "native"}), ("--out", {}))
    return top


def _show(answer, args) -> None:
    if args.json or not isinstance(answer, dict):
        print(json.dumps(answer, ensure_ascii=False))
        return
    for key, value in answer.items():
        if isinstance(value, list):
            print(f"{key}:")
            for row in value:
                print("  " + ("  ".join(f"{k}={v}" for k, v in row.items()) if isinstance(row, dict) else str(row)))
        else:
            print(f"{key}: {human_size(value) if key == 'size' else value}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done; 1: the gate found drift, or there is nothing to show; 2: something is missing."""
    args = parser().parse_args(argv)
    spark, root = spark or _session(), args.root
    if args.command == "build":
        graph, manifest = index(spark, root)
        store.save(root, graph, manifest)
        print(f"{graph.nodes.count()} nodes, {graph.edges.count()} edges")
        return 0
    if args.command == "watch":
        watch(spark, root, args.interval)
        return 0
    if args.command == "serve":
        for answer in serve(Service(spark, root, args.strategy), sys.stdin):
            print(answer, flush=True)
        return 0
    if args.command == "doctor":
        found = examine(spark, root)
        print(json.dumps([vars(f) for f in found]) if args.json else "\n".join(f"{'ok' if f.good else 'NEEDED' if f.needed else '-':7}{f.about}: {f.says}" for f in found))
        return int(any(f.needed and not f.good for f in found))
    if args.command == "install-hook":
        try:
            print(install_hook(root))
        except (FileNotFoundError, FileExistsError) as e:
            print(e, file=sys.stderr)
            return 2
        return 0
    if args.command == "gate":
        graph, old = store.load_graph(spark, root), store.load_manifest(spark, root)
        if graph is None or old is None:
            print("nothing is stored yet; build first", file=sys.stderr)
            return 2
        found = gate.drift(graph, old, gate.manifest_of(read_corpus(spark, root)))
        print(json.dumps(found.facts(), ensure_ascii=False) if args.json else "\n".join(found.report()))
        return 0 if found.passes else 1
    graph = store.load_or_build(spark, root)
    match args.command:
        case "stats":
            _show({"counts": [r.asDict() for r in g.counts(graph).orderBy("what", "name").collect()]}, args)
        case "map":
            _show(query.project_map(graph, args.top, args.strategy), args)
        case "find":
            _show({"hits": [r.asDict() for r in query.find(graph, args.query, args.limit).collect()]}, args)
        case "neighbors":
            got = query.neighbors(graph, args.id)
            if got is None:
                print(f"no such node: {args.id}", file=sys.stderr)
                return 1
            _show(got, args)
        case "focus":
            _show(query.focus(graph, args.query, args.budget, args.strategy), args)
        case "impact":
            seeds = changed_files(root) if args.diff else None
            if seeds == []:
                print("nothing has changed")
                return 0
            if seeds is None and not args.query:
                print("a seed or --diff is needed", file=sys.stderr)
                return 2
            _show(query.impact(graph, args.query or "", seeds, args.budget, query.DEPENDENCIES if args.deps else query.DEPENDENTS, args.hops, args.strategy), args)
        case "why":
            got = query.why(graph, args.a, args.b, args.strategy)
            _show(got, args)
            return 0 if got["found"] else 1
        case "tour":
            _show(query.tour(graph, args.budget, args.stops, args.strategy), args)
        case "view":
            if args.focus:
                ids = [n["id"] for n in query.focus(graph, args.focus, strategy=args.strategy)["nodes"]]
                graph = g.induced_subgraph(graph, spark.createDataFrame([(i,) for i in ids], "id string"))
            elif graph.nodes.limit(VIEW_LIMIT + 1).count() > VIEW_LIMIT:
                graph = g.backbone(graph, VIEW_LIMIT, strategy=args.strategy)
            out = Path(args.out or Path(root) / store.FOLDER / "view.html")
            store.write_whole(out, render_view(graph, args.strategy))
            print(out)
        case "export":
            text = export(graph, args.format)
            if args.out:
                store.write_whole(Path(args.out), text)
            else:
                print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
