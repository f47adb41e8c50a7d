"""Column expressions and primitives on small inputs."""

import pytest
from pyspark.sql import functions as F

from strataweave.functions import extract, labels, paths, tokens
from strataweave.functions.syntax import python_module
from strataweave.model import Graph, edges_frame, nodes_frame
from strataweave.operators import graph as g
from strataweave.operators.rank import pagerank
from strataweave.operators.traverse import reading_order
from strataweave.plans import gate
from strataweave.sources.aliases import alias_rules, relaxed_json
from strataweave.sources.files import git_files, list_files, skipped
from strataweave.sources.history import parsed_log


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expression(F.col("v")).alias("r")).collect()
    return [r["r"] for r in rows]


def test_paths(spark):
    import posixpath

    odd = ["a/b/../c", "./x", "../up/./y", "a//b/", "", "/a/../../b", "..", "a/..", "//h/x", "///h"]
    assert column(spark, odd, paths.normalised) == [posixpath.normpath(p) for p in odd]
    names = ["a.py", "d/.env", "x.tar.gz", "none", "..a", ".a.b", "a."]
    assert column(spark, names, paths.extension) == [posixpath.splitext(p)[1] for p in names]
    assert column(spark, ["a.b.c", "x", ".env"], paths.stem) == ["a.b", "x", ""]
    assert column(spark, ["a/b/c.py", "c.py"], paths.parents) == [["a", "a/b"], []]


@pytest.mark.parametrize(
    ("path", "category", "layer"),
    [("src/MAIN.py", "code", "entrypoint"), ("memory/x.csv", "memory", "docs"), (".env", "doc", "docs"), (".gitignore", "config", "config"), ("README.md", "structure", "docs"), ("a/b.parquet", "data", "data"), ("x/tests/a.py", "code", "tests"), ("x/user_service.go", "code", "service"), ("q.unknown", "config", "config"), ("lib/views/z.js", "code", "ui"), ("core/a.rs", "code", "core"), ("Dockerfile", "config", "config")],
)
def test_labels(spark, path, category, layer):
    row = spark.createDataFrame([(path,)], "p string").select(labels.category(F.col("p")).alias("c"), "p").select("c", labels.layer(F.lit("file"), F.col("p"), F.col("c")).alias("l")).first()
    assert (row["c"], row["l"]) == (category, layer)


def test_tokens(spark):
    import json

    assert column(spark, ["", "ab", "abcdefghij", "x" * 14, "é😀"], tokens.estimated) == [1, 1, 2, 4, 1]
    odd = ['a"b\\c', "t\tn\nr\r", "é😀\x01"]
    assert column(spark, odd, tokens.quoted) == [json.dumps(x, ensure_ascii=False) for x in odd]
    assert tokens.human_size(12) == "12 B" and tokens.human_size(2048) == "2.0 KB"


def test_references(spark):
    text = "See [a](src/a.py#x), [[Note|alias]], src/b.py, [w](https://e.org/x.md) and città.py; mailto:x@y.com [m](mailto:a@b.c) 10.0.0.1"
    got = [(r["target"], r["kind"]) for r in column(spark, [text], lambda t: extract.references(t, F.lit(False)))[0]]
    assert got[:2] == [("src/a.py", "link"), ("Note", "wikilink")] and ("src/b.py", "path") in got and ("a@b.c", "link") not in got and not any("https" in t for t, _ in got)
    page = """<a href="docs/x.md"></a><script>a](b.md)</script><img src='i.png'><a HREF="p.html?q#z">"""
    assert [(r["target"], r["kind"]) for r in column(spark, [page], lambda t: extract.references(t, F.lit(True)))[0]] == [("docs/x.md", "link"), ("p.html", "link")]
    assert column(spark, ["ADR-9, then D-KEY-3; RFC-12 (not XADR-1), ADR-9"], extract.decisions) == [["ADR-9", "D-KEY-3", "RFC-12"]]
    assert column(spark, ["import a from './a';\nexport * from \"b\";\nrequire('c')\nimport 'd'"], extract.specifiers) == [["./a", "b", "c", "d"]]
    assert column(spark, ["E::class => [A::class, B::class], N::class => []"], extract.listener_pairs)[0][0].asDict() == {"event": "E", "listeners": ["A", "B"]}


def test_python_syntax():
    symbols, imports = python_module("from . import x\nimport a.b\nclass K:\n    y = f()\n    async def m(self):\n        def inner(): g()\n        self.h()\nif 1:\n    def no(): pass\n")
    assert [(s["qualname"], s["kind"], s["lineno"], s["calls"]) for s in symbols] == [("K", "class", 3, ["f"]), ("K.m", "function", 5, ["g", "h"])]
    assert imports == [{"level": 1, "module": None, "names": ["x"]}, {"level": 0, "module": "a.b", "names": []}] and python_module("def (") == ([], [])


def small(spark, edges, ids="abcd"):
    nodes = nodes_frame(spark.createDataFrame([(i, "file", i, i, "code") for i in ids], "id string, kind string, label string, path string, category string"))
    return Graph(nodes, edges_frame(spark.createDataFrame(edges, "src string, dst string, type string")))


def test_primitives(spark):
    graph = small(spark, [("a", "b", "imports"), ("a", "b", "calls"), ("b", "c", "references"), ("c", "c", "mentions"), ("d", "gone", "other")])
    assert {r["id"]: r["deg"] for r in g.degrees(graph).collect()} == {"a": 2, "b": 3, "c": 3, "d": 1}
    assert {r["id"] for r in g.neighbour_ids(graph, "c").collect()} == {"b", "c"}
    w = {(r["a"], r["b"]): r["w"] for r in g.undirected_weights(graph).collect()}
    assert w == {("a", "b"): 2.0, ("b", "a"): 2.0, ("b", "c"): 0.8, ("c", "b"): 0.8, ("c", "c"): 1.2}
    assert g.induced_subgraph(graph, spark.createDataFrame([("a",), ("b",), ("zz",)], "id string")).edges.count() == 2
    seeds = spark.createDataFrame([("a", 2.0), ("b", -1.0), ("zz", 5.0)], "id string, weight double")
    one, two = ({r["id"]: r["score"] for r in pagerank(graph, seeds, iterations=2, tolerance=0.0, strategy=s).collect()} for s in ("local", "distributed"))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one) and sum(one.values()) == pytest.approx(1)


def test_order():
    score = [("a", 0.1), ("b", 0.5), ("c", 0.5), ("d", 0.2)]
    assert reading_order(score, [("a", "d"), ("b", "a")]) == ["c", "d", "a", "b"]
    assert reading_order(score[:2], [("a", "b"), ("b", "a")]) == ["b", "a"]


def test_manifests(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, sig string")
    new = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "path string, sig string")
    assert {tuple(r) for r in gate.diff_manifest(old, new).collect()} == {("a", "removed"), ("b", "changed"), ("d", "added")}


def test_sources(spark, tmp_path):
    assert relaxed_json('{"a": 1, /* x */ // y\n "b": [1,],}') == {"a": 1, "b": [1]} and relaxed_json("[1]") == {} and relaxed_json("{") == {}
    config = {"compilerOptions": {"paths": {"@app/*": ["src/app/*"], "lib": ["lib/index"], "bad": 3}}}
    assert alias_rules(config, True) == [("@app/", "src/app"), ("lib", "lib/index"), ("@/", "src"), ("~/", "src")] and alias_rules({"compilerOptions": {"baseUrl": "web", "paths": {"@/*": ["code/*"], "a*b/*": ["x/*"], "n/*": ["m"]}}}, True) == [("@/", "web/code"), ("~/", "src")]
    for name in ("a.py", "x.pyc", "node_modules/m.js", "p.egg-info/q.txt", "keep/b.md", "keep/b.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".graphignore").write_text("# no logs\n*.log\n")
    if git_files(tmp_path) is None:
        assert list_files(tmp_path) == ["a.py", "keep/b.md"]
    assert column(spark, ["a.py", "x.pyc", "node_modules/m.js", "keep/b.log"], lambda p: skipped(p, ["*.log"])) == [False, True, True, True]
    log = "\x1eh1\x1fsubject one\x1f2024-01-02T03:04:05+00:00\x1fAnn\na.py\nb/c.py\n\n\x1eh2\x1fs\x1fd\x1fB"
    got = column(spark, [log], parsed_log)[0]
    assert [(c["hash"], c["author"], c["files"]) for c in got] == [("h1", "Ann", ["a.py", "b/c.py"]), ("h2", "B", [])]


def test_blocks(spark, monkeypatch):
    """Many blocks, hubs whose links lie where they end, ends that are no nodes, and nodes without links give what arrays give."""
    from strataweave.operators import rank

    ids = [f"f{k}" + (f"#s{j}" if j else "") for k in range(40) for j in range(4)] + ["hub", "alone"]
    edges = [(f"f{k}", f"f{k}#s{j}", "defines") for k in range(40) for j in range(1, 4)] + [(i, "hub", "belongs_to") for i in ids[:-1]] + [(f"f{k}#s1", f"f{k * 7 % 40}", "calls") for k in range(40)]
    graph = small(spark, [*edges, ("hub", "gone", "other"), ("gone", "f1", "other"), ("gone", "lost", "other"), ("f1", "f2", "calls"), ("f1", "f2", "imports")], ids)
    monkeypatch.setattr(rank, "BLOCK_LINKS", 100)
    monkeypatch.setattr(rank, "PLACE_LINKS", 60)
    block, n, hubs = rank.blocks(graph.edges)
    assert n == 7 and hubs == [graph.nodes.where("id = 'hub'").select(rank.name_of(F.col("id"))).first()[0]]
    seeds = spark.createDataFrame([("f3", 1.0), ("alone", 1.0)], "id string, weight double")
    for given in (None, seeds):
        one, two = ({r["id"]: r["score"] for r in pagerank(graph, given, iterations=7, tolerance=0.0, strategy=s).collect()} for s in ("local", "distributed"))
        assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-14) for k in one)
    monkeypatch.setattr(rank, "BLOCK_LINKS", 20)
    flat = small(spark, [("x#a", f"x#{k}", "calls") for k in range(300)], [f"x#{k}" for k in range(300)] + ["x#a"])
    block, n, _ = rank.blocks(flat.edges)
    assert flat.nodes.select(block(F.col("id")).alias("b")).distinct().count() > 1


def test_layers_search_once(spark):
    """All words of all layers, and a plan that doesn't split the path again for each layer."""
    words = [(name, w) for name, ws in labels.LAYER_WORDS for w in ws.split() if "_" not in w]
    shapes = [f"x/{w}/a.rs" for _, w in words] + [f"x/q-{w}_z.rs" for _, w in words] + [f"x/{w}.rs" for _, w in words] + [f"x/{w}x/y{w}.rs" for _, w in words]
    rows = spark.createDataFrame([(p,) for p in shapes], "p string").select("p", labels.layer(F.lit("file"), F.col("p"), F.lit("code")).alias("l"))
    assert [r["l"] for r in rows.collect()] == [name for name, _ in words] * 3 + ["core"] * len(words)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") < 20, plan.count("lower(")
    two = spark.createDataFrame([("views/api.rs",), ("libs/main/db.rs",)], "p string").select(labels.layer(F.lit("file"), F.col("p"), F.lit("code")).alias("l"))
    assert [r["l"] for r in two.collect()] == ["api", "entrypoint"]


def test_parsing_is_spread(spark):
    from strataweave.functions.syntax import parsed

    corpus = spark.range(40).coalesce(1).select(F.format_string("m%d.py", "id").alias("path"), F.lit(".py").alias("ext"), F.lit("def f(): pass").alias("text"))
    used = parsed(corpus).select(F.spark_partition_id().alias("p"), F.size("symbols").alias("n")).collect()
    assert len(used) == 40 and {r["n"] for r in used} == {1} and len({r["p"] for r in used}) > 3
