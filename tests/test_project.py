"""What surrounds the queries: commands, tools, watching, hooks, the doctor, history, and languages other than Python."""

import io
import json
import subprocess
import sys
import types

import pytest
from pyspark.sql import functions as F

from strataweave import cli, doctor
from strataweave.functions import syntax
from strataweave.plans import build
from strataweave.service import Service, described, serve
from strataweave.sources import files, history
from strataweave.streaming import watch

FILES = {"a/one.py": "from a import two\n\n\ndef go():\n    return two.stay()\n", "a/two.py": "def stay():\n    return 1\n", "doc.md": "See a/one.py and [gone](a/gone.py). ADR-3\n"}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=A", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)


def test_commands(spark, root, capsys, monkeypatch):
    def run(*args):
        code = cli.main([*args, "--root", str(root)], spark)
        return code, capsys.readouterr()

    assert run("gate")[0] == 2 and run("doctor")[0] == 1
    code, said = run("build")
    assert code == 0 and "nodes" in said.out and run("doctor")[0] == 0
    code, said = run("gate", "--json")
    facts = json.loads(said.out)
    assert code == 1 and facts["broken"] == 1 and facts["stale_files"] == {"added": [], "removed": [], "changed": []}
    (root / "a/two.py").write_text("def stay():\n    return 2\n")
    assert "~1 changed" in run("gate")[1].out
    for args, part in ((["stats"], "file"), (["map"], "symbols"), (["find", "stay"], "a/two.py#stay"), (["neighbors", "a/one.py"], "imports"), (["focus", "stay"], "a/two.py#stay"), (["impact", "a/two.py"], "a/one.py"), (["why", "doc.md", "a/two.py"], "a/one.py"), (["tour"], "a/two.py"), (["export", "--format", "dot"], "digraph")):
        code, said = run(*args)
        assert code == 0 and part in said.out, args
    assert json.loads(run("focus", "stay", "--json")[1].out)["nodes"][0]["id"] == "a/two.py#stay"
    assert run("neighbors", "none")[0] == 1 and run("impact")[0] == 2 and run("why", "zz", "yy")[0] == 1 and run("impact", "--diff")[0] == 0
    code, said = run("view")
    assert code == 0 and "a/one.py" in (root / ".strataweave/view.html").read_text()
    assert run("export", "--out", str(root / "g.json"))[0] == 0 and json.loads((root / "g.json").read_text())["nodes"]
    monkeypatch.setattr(sys, "stdin", io.StringIO('{"tool": "find", "arguments": {"text": "one"}}\n'))
    assert "a/one.py" in run("serve")[1].out
    assert run("install-hook")[0] == 2
    with pytest.raises(SystemExit):
        run("nothing")


def test_tools(spark, root):
    service = Service(spark, str(root))
    assert service.health() == {"status": "nothing is stored yet"}
    cli.main(["build", "--root", str(root)], spark)
    first = service.graph()
    assert service.graph() is first and service.health()["broken"] == 1
    lines = ['{"tool": "neighbors", "arguments": {"node_id": "a/one.py"}}', "", "{half", "[1]", '{"tool": "nothing"}', '{"tool": "why", "arguments": {"a": "x"}}', '{"tool": "tools"}', '{"tool": "impact", "arguments": {"seed": "a/two.py"}}', '{"tool": "neighbors", "arguments": {"node_id": "zz"}}']
    got = [json.loads(x) for x in serve(service, lines)]
    assert got[0]["result"]["id"] == "a/one.py" and all("error" in x for x in got[1:5]) and len(got[5]["result"]) == len(described()) == 8
    assert "a/one.py" in {n["id"] for n in got[6]["result"]["nodes"]} and got[7]["result"]["error"]
    cli.main(["build", "--root", str(root)], spark)
    assert service.graph() is not first


def test_watch(spark, root):
    seen = []
    note = lambda df: seen.append({tuple(r) for r in df.collect()})
    watch.watch(spark, str(root), 0, note, 1)
    assert seen == [{(p, "added") for p in FILES}]
    (root / "doc.md").unlink()
    (root / "a/two.py").write_text("x = 1\n")
    (root / "new.md").write_text("hello")
    watch.watch(spark, str(root), 0, note, 2)
    assert seen[1:] == [{("doc.md", "removed"), ("a/two.py", "changed"), ("new.md", "added")}]
    (root / "new.md").write_text("bye")
    ticking = watch.watch_stream(spark, str(root), note, 1)
    try:
        for _ in range(120):
            if len(seen) > 2 or not ticking.isActive:
                break
            ticking.awaitTermination(1)
    finally:
        ticking.stop()
    assert seen[2] == {("new.md", "changed")}


def test_git(spark, root):
    git(root, "init", "-q")
    git(root, "add", ".")
    git(root, "commit", "-qm", "first things")
    assert sorted(files.git_files(root)) == sorted(FILES)
    (c,) = history.commits(spark, root).collect()
    assert c["subject"] == "first things" and sorted(c["files"]) == sorted(FILES) and c["author"] == "A"
    (root / "doc.md").write_text("changed")
    assert history.changed_files(root) == ["doc.md"]
    graph, _ = build.index(spark, str(root))
    session = graph.nodes.where("kind = 'session'").first()
    assert session["id"] == f"session:{c['hash']}" and session["label"].endswith("first things") and graph.edges.where("type = 'touches'").count() == len(FILES)
    hook = watch.install_hook(str(root))
    assert watch.install_hook(str(root)) == hook and hook.stat().st_mode & 0o111
    assert {f.about: f.good for f in doctor.examine(spark, str(root))}["hook"]
    hook.write_text("#!/bin/sh\nexit 0\n")
    with pytest.raises(FileExistsError):
        watch.install_hook(str(root))
    (root / "deeper").mkdir()
    with pytest.raises(FileNotFoundError):
        watch.install_hook(str(root / "deeper"))


def test_signatures(spark, root):
    (root / "big.bin").write_bytes(b"x" * 1_500_000)
    rows = {r["path"]: r["sig"] for r in files.read_corpus(spark, str(root)).collect()}
    assert len(set(rows.values())) == len(rows) and all(rows.values())
    (root / "a/one.py").write_text("other")
    again = {r["path"]: r["sig"] for r in files.read_corpus(spark, str(root)).collect()}
    assert {p for p in rows if rows[p] != again[p]} == {"a/one.py"}


class Piece:
    """A node of a syntax tree, as far as symbols need it."""

    def __init__(self, kind, start, end, line, children=(), **fields):
        self.type, self.start_byte, self.end_byte, self.start_point = kind, start, end, (line, 0)
        self.children = self.named_children = [*fields.values(), *children]
        self.fields = fields

    def child_by_field_name(self, name):
        return self.fields.get(name)


def test_grammars(monkeypatch):
    source = "class Box { open() { lift(); } }"

    def parse(data):
        at = lambda word: (data.index(word), data.index(word) + len(word))
        call = Piece("call_expression", *at(b"lift()"), 0, function=Piece("identifier", *at(b"lift"), 0))
        method = Piece("method_definition", *at(b"open() { lift(); }"), 0, [call], name=Piece("property_identifier", *at(b"open"), 0))
        box = Piece("class_declaration", 0, len(data), 0, [method], name=Piece("type_identifier", *at(b"Box"), 0))
        return types.SimpleNamespace(root_node=Piece("program", 0, len(data), 0, [box]))

    fake = types.ModuleType("tree_sitter_language_pack")
    fake.get_parser = lambda language: types.SimpleNamespace(parse=parse)
    monkeypatch.setitem(sys.modules, "tree_sitter_language_pack", fake)
    got = syntax.grammar_symbols("javascript", source)
    assert [(s["qualname"], s["kind"], s["lineno"], s["calls"]) for s in got] == [("Box", "class", 1, []), ("Box.open", "function", 1, ["lift"])]
    assert [s["lineno"] for s in syntax.symbols_of(".vue", f"<template/>\n\n<script lang='ts'>{source}</script>")] == [3, 3]

    def fail(language):
        raise LookupError(language)

    fake.get_parser = fail
    assert syntax.grammar_symbols("javascript", source) == []


def test_wiring(spark):
    rows = [("routes/web.php", "Route::get('/x', [HomeController::class, 'i']); Route::get('/y', [Twice::class]);"), ("app/EventServiceProvider.php", "Paid::class => [SendBill::class, Twice::class, Paid::class]"), ("app/x.php", "SendBill::class")]
    corpus = spark.createDataFrame(rows, "path string, text string")
    names = [("HomeController", "a"), ("SendBill", "b"), ("Paid", "c"), ("Twice", "d"), ("Twice", "e")]
    symbols = spark.createDataFrame([(f"app/{f}.php", 0, n, n, "class", 1, [], f"app/{f}.php#{n}") for n, f in names], "file string, seq int, name string, qualname string, kind string, lineno int, calls array<string>, id string")
    got = {tuple(r) for r in build.wiring_edges(corpus, symbols).select("src", "dst", "type").collect()}
    assert got == {("routes/web.php", "app/a.php#HomeController", "references"), ("app/b.php#SendBill", "app/c.php#Paid", "references")}


def test_parsed_without_grammars(spark):
    rows = spark.createDataFrame([("x.go", ".go", "func A() {}"), ("y.py", ".py", "def f(): pass"), ("z.py", ".py", None)], "path string, ext string, text string")
    assert {r["file"]: [s["name"] for s in r["symbols"]] for r in syntax.parsed(rows).withColumn("n", F.size("symbols")).collect()} == {"x.go": [], "y.py": ["f"], "z.py": []}
