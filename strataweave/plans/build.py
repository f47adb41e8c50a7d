"""From a corpus to the typed graph: extraction, then resolution by joins, then union.

Every resolution is an equi-join of candidates with an index of the project, candidates carrying the order in which they are to be tried;
the first that exists wins. Small sides that depend on configuration alone (aliases) are crossed with what they can match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.labels import category
from ..functions.paths import basename, dirname, extension, joined, normalised, parents, stem, top_area
from ..functions.syntax import SYMBOL_TYPES, parsed
from ..model import EDGE_COLUMNS, ROOT_AREA, Graph, edges_frame, graph_of, nodes_frame

SCRIPT_TYPES = [f".{x}" for x in "cjs js jsx mjs ts tsx vue".split()]
DOCUMENT_TYPES = [f".{x}" for x in "adoc htm html markdown md rst txt".split()]
RUNTIME_TYPES = [f".{x}" for x in "cjs js jsx mjs".split()]
SUFFIXES = ["", *(f".{x}" for x in "ts tsx js jsx mjs cjs vue".split()), *(f"/index.{x}" for x in "ts js vue".split())]
PACKAGE_ENTRIES = "src/index|index|src|".split("|")


def file_nodes(corpus: DataFrame) -> DataFrame:
    p = F.col("path")
    return corpus.select(p.alias("id"), F.lit("file").alias("kind"), basename(p).alias("label"), p.alias("path"), category(p).alias("category"), "size")


def area_nodes(corpus: DataFrame) -> DataFrame:
    area = corpus.select(top_area(F.col("path")).alias("label")).distinct()
    return area.select(F.concat(F.lit("area:"), F.col("label")).alias("id"), F.lit("area").alias("kind"), "label")


def area_edges(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("path").alias("src"), F.concat(F.lit("area:"), top_area(F.col("path"))).alias("dst"), F.lit("belongs_to").alias("type"))


def directories(corpus: DataFrame) -> DataFrame:
    """dir: every directory that holds a file, at any depth."""
    return corpus.select(F.explode(parents(F.col("path"))).alias("dir")).distinct()


def name_index(corpus: DataFrame, key: Column) -> DataFrame:
    """key, n, low, high: how many files have it, and the first and last of them."""
    return corpus.select(key.alias("key"), "path").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("low"), F.max("path").alias("high"))


# -- imports of Python


def module_map(corpus: DataFrame) -> DataFrame:
    """dotted, target: the file of each module or package; packages come before modules, the last of them, and the first of modules."""
    dotted = F.translate(F.expr("substring(path, 1, char_length(path) - 3)"), "/", ".")
    rows = corpus.where(F.lower(extension(F.col("path"))) == ".py").select("path", dotted.alias("full")).where("full <> '__init__'")
    package = F.col("full").endswith(".__init__")
    rows = rows.select(F.when(package, F.expr("substring(full, 1, char_length(full) - 9)")).otherwise(F.col("full")).alias("dotted"), F.when(package, F.col("path")).alias("pack"), F.when(~package, F.col("path")).alias("mod"))
    return rows.groupBy("dotted").agg(F.coalesce(F.max("pack"), F.min("mod")).alias("target"))


def import_candidates(imports: DataFrame) -> DataFrame:
    """file, dotted: every module that an import statement could mean. imports: file, level, module, names."""
    parts = F.split("file", "/")
    package = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    keep = F.size(package) - (F.col("level") - 1)
    named = F.coalesce(F.col("module"), F.lit("")) != ""
    here = F.concat(F.slice(package, 1, F.greatest(keep, F.lit(0))), F.when(named, F.split("module", r"\.")).otherwise(F.array().cast("array<string>")))
    prefix = F.when(F.col("level") == 0, F.when(named, F.array("module"))).otherwise(F.when(keep >= 0, here))
    whole = F.when(named, F.array(F.array_join(prefix, "."))).otherwise(F.array().cast("array<string>"))
    every = F.concat(whole, F.transform("names", lambda n: F.array_join(F.concat(prefix, F.array(n)), ".")))
    return imports.select("file", F.explode(F.when(prefix.isNotNull(), every)).alias("dotted")).distinct()


def python_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    found = import_candidates(imports).join(modules, "dotted").where("file <> target")
    return found.select(F.col("file").alias("src"), F.col("target").alias("dst"), F.lit("imports").alias("type")).distinct()


# -- imports of scripts


def package_map(corpus: DataFrame) -> DataFrame:
    """name, dir: the packages of a workspace; of several with a name the last path wins."""
    found = corpus.where((basename(F.col("path")) == "package.json") & F.col("text").isNotNull())
    name = F.try_variant_get(F.try_parse_json("text"), "$.name", "string")
    is_text = F.regexp_extract(F.schema_of_variant(F.try_variant_get(F.try_parse_json("text"), "$.name", "variant")), "^STRING$", 0) == "STRING"
    rows = found.select("path", F.when(is_text, name).alias("name")).where("name <> ''")
    return rows.groupBy("name").agg(F.max("path").alias("path")).select("name", dirname(F.col("path")).alias("dir"))


def suffix_index(ids: DataFrame) -> DataFrame:
    """base, k, id: each id without every suffix that it ends with; k is the place of the suffix."""
    i = F.col("id")
    ends = [F.when(i.endswith(s), F.struct(F.substring(i, F.lit(1), F.char_length(i) - len(s)).alias("base"), F.lit(k).alias("k"))) for k, s in enumerate(SUFFIXES)]
    return ids.select("id", F.inline(F.filter(F.array(*ends), lambda e: e.isNotNull()))).distinct()


def probes(rows: DataFrame, base: str, first: Column) -> DataFrame:
    """file, spec, ord, base of rows (file, spec, and a column of bases): a base is tried with each suffix; then, if it ends like compiled code, without that end."""
    ext = extension(F.col(base))
    short = F.substring(F.col(base), F.lit(1), F.char_length(base) - F.char_length("ext"))
    whole = F.struct(first.alias("ord"), F.col(base).alias("base"))
    less = F.when(F.col("ext").isin(*RUNTIME_TYPES), F.struct((first + len(SUFFIXES)).alias("ord"), short.alias("base")))
    return rows.withColumn("ext", ext).select("file", "spec", F.inline(F.filter(F.array(whole, less), lambda x: x.isNotNull())))


def script_imports(specs: DataFrame, ids: DataFrame, aliases: list[tuple[str, str]], packages: DataFrame) -> DataFrame:
    """Edges of specs (file, spec): relative paths, else aliases, longest first, else the package of the longest name that leads the specifier."""
    spec = F.col("spec")
    near = specs.where(spec.startswith(".")).withColumn("dir", dirname(F.col("file"))).withColumn("raw", joined(F.col("dir"), spec)).withColumn("base", normalised(F.col("raw")))
    near = probes(near, "base", F.lit(0))
    far = specs.where(~spec.startswith("."))
    parts = [near]
    for k, (prefix, to) in enumerate(aliases):
        raw = F.concat(F.lit(to + "/"), F.expr(f"substring(spec, {len(prefix) + 1})"))
        parts.append(probes(far.where(spec.startswith(prefix)).withColumn("raw", raw).withColumn("base", normalised(F.col("raw"))), "base", F.lit(100 * k)))
    bits = F.split("spec", "/")
    leads = far.select("file", "spec", F.explode(F.transform(F.sequence(F.lit(1), F.size(bits)), lambda i: F.array_join(F.slice(bits, 1, i), "/"))).alias("name"))
    best = leads.join(packages, "name").groupBy("file", "spec").agg(F.max_by("name", F.char_length("name")).alias("name"), F.max_by("dir", F.char_length("name")).alias("dir"))
    sub = F.regexp_replace(F.expr("substring(spec, char_length(name) + 1)"), "^/+", "")
    best = best.select("file", "spec", F.when(F.col("dir") == "", ".").otherwise(F.col("dir")).alias("dir"), sub.alias("sub"))
    start = 100 * len(aliases)
    inner = best.where("sub <> ''").withColumn("raw", joined(F.col("dir"), F.col("sub"))).withColumn("base", normalised(F.col("raw")))
    parts.append(probes(inner, "base", F.lit(start)))
    entry = F.array(*[F.struct(F.lit(start + 100 * k).alias("ord"), (joined(F.col("dir"), F.lit(e)) if e else F.col("dir")).alias("raw")) for k, e in enumerate(PACKAGE_ENTRIES)])
    parts.append(best.where("sub = ''").select("file", "spec", F.inline(entry)).select("file", "spec", "ord", normalised(F.col("raw")).alias("base")))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    # ids lose their suffixes once, instead of every specifier trying them all
    hit = found.join(suffix_index(ids), "base").where("id <> file").groupBy("file", "spec").agg(F.min_by("id", F.col("ord") + F.col("k")).alias("dst"))
    return hit.select(F.col("file").alias("src"), "dst", F.lit("imports").alias("type")).distinct()


# -- references of documents


def document_references(documents: DataFrame) -> DataFrame:
    """file, target, kind, ord of the first of each target. documents: path, ext, text."""
    html = F.col("ext").isin(".htm", ".html")
    found = documents.select(F.col("path").alias("file"), F.posexplode(extract.references(F.col("text"), html)).alias("ord", "r"))
    return found.groupBy("file", F.col("r.target").alias("target")).agg(F.min("ord").alias("ord"), F.min_by("r.kind", "ord").alias("kind"))


def external(target: Column) -> Column:
    return target.contains("://") | target.startswith("//") | target.rlike(r"(?U)^\p{L}:")


def resolved_references(refs: DataFrame, corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """refs with resolved (an id or null) and broken: as a path from the document, then from the root, then a base name and then a stem that only one other file has."""
    target, file = F.col("target"), F.col("file")
    base = F.substring_index(target, "/", -1)
    rows = refs.withColumn("dir", dirname(file)).withColumn("raw", joined(F.col("dir"), target)).withColumn("bare", F.regexp_replace(target, "^/+", ""))
    rows = rows.withColumn("near", normalised(F.col("raw"))).withColumn("rooted", normalised(F.col("bare"))).withColumn("base", base).withColumn("stem", stem(F.col("base")))
    rows = rows.drop("dir", "raw", "bare")
    # ids and directories in one table: one join for each way to read a target
    known = ids.select("id", F.lit(True).alias("is_id"), F.lit(None).cast("boolean").alias("is_dir")).union(directories(corpus).select("dir", F.lit(None), F.lit(True)))
    known = known.groupBy("id").agg(F.max("is_id").alias("is_id"), F.max("is_dir").alias("is_dir"))
    for c in ("near", "rooted"):
        rows = rows.join(known.select(F.col("id").alias(c), F.col("is_id").alias(f"{c}_id"), F.col("is_dir").alias(f"{c}_dir")), c, "left")
    for c, key in (("base", basename(F.col("path"))), ("stem", stem(basename(F.col("path"))))):
        index = name_index(corpus, key).where("n <= 2").select(F.col("key").alias(c), F.col("n").alias(f"{c}_n"), F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high"))
        rows = rows.join(index, c, "left")
        n, low, high = (F.col(f"{c}_{x}") for x in ("n", "low", "high"))
        rows = rows.withColumn(f"{c}_hit", F.when((n == 1) & (low != file), low).when((n == 2) & (low == file), high).when((n == 2) & (high == file), low))
    exact = F.when(F.col("near_id"), F.col("near")).when(F.col("rooted_id"), F.col("rooted"))
    other = F.when(exact.isNull(), F.coalesce("base_hit", "stem_hit"))
    noise = (F.col("kind") == "path") | external(target) | F.col("near").startswith("../") | F.col("rooted").startswith("../") | F.col("near_dir").isNotNull() | F.col("rooted_dir").isNotNull()
    noise = noise | ((F.col("kind") == "wikilink") & ~target.contains("/") & ~F.col("base").contains("."))
    broken = exact.isNull() & other.isNull() & ~noise
    return rows.select("file", "target", "kind", "ord", F.when(exact != file, exact).otherwise(other).alias("resolved"), F.coalesce(broken, F.lit(False)).alias("broken"))


# -- symbols and calls


def symbol_rows(syntax: DataFrame) -> DataFrame:
    """file, seq, name, qualname, kind, lineno, calls and id of every definition, repeated ones too."""
    rows = syntax.select("file", F.posexplode("symbols").alias("seq", "s"))
    return rows.select("file", "seq", "s.*", F.concat("file", F.lit("#"), F.col("s.qualname")).alias("id"))


def first_definitions(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("id", "file").agg(F.min_by(F.struct("qualname", "kind", "lineno"), "seq").alias("s")).select("id", "file", "s.*")


def call_edges(symbols: DataFrame) -> DataFrame:
    """A called name means the first of the caller's own file, else the only one of the project; never the caller itself."""
    calls = symbols.select(F.col("id").alias("src"), "file", F.explode("calls").alias("name")).distinct()
    own = symbols.groupBy("file", "name").agg(F.min_by("id", "seq").alias("own"))
    only = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only")).where("n = 1")
    found = calls.join(own, ["file", "name"], "left").join(only.select("name", "only"), "name", "left")
    return found.select("src", F.coalesce("own", "only").alias("dst"), F.lit("calls").alias("type")).where("dst <> src").distinct()


def wiring_edges(corpus: DataFrame, symbols: DataFrame) -> DataFrame:
    """Framework conventions: a route file refers to the classes it names, a listener to its event; names must belong to one class of the project."""
    kinds = first_definitions(symbols).where("kind = 'class'").select("id")
    unique = symbols.select("name", "id").join(kinds, "id", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select("name", "id")
    php = corpus.where(F.col("path").endswith(".php") & F.col("text").isNotNull())
    route = php.where(extract.is_route_file(F.col("path"))).select(F.col("path").alias("src"), F.explode(extract.class_names(F.col("text"))).alias("name"))
    route = route.join(unique.withColumnRenamed("id", "dst"), "name").select("src", "dst")
    events = php.where(extract.is_event_provider(F.col("path")) & ~extract.is_route_file(F.col("path"))).select(F.explode(extract.listener_pairs(F.col("text"))).alias("p"))
    events = events.select(F.col("p.event").alias("event"), F.explode("p.listeners").alias("listener"))
    events = events.join(unique.select(F.col("name").alias("event"), F.col("id").alias("dst")), "event").join(unique.select(F.col("name").alias("listener"), F.col("id").alias("src")), "listener")
    return route.union(events.select("src", "dst").where("src <> dst")).distinct().withColumn("type", F.lit("references"))


def session_rows(commits: DataFrame) -> DataFrame:
    """A node for each commit."""
    label = F.substring(F.trim(F.concat_ws(" ", "hash", "subject")), 1, 80)
    text = F.trim(F.concat(F.lit("commit "), F.col("hash"), F.lit(" by "), F.col("author"), F.lit(" "), F.substring("date", 1, 10)))
    return commits.select(F.concat(F.lit("session:"), F.col("hash")).alias("id"), F.lit("session").alias("kind"), label.alias("label"), text.alias("description"), "date", "author", "subject")


def session_edges(commits: DataFrame, ids: DataFrame) -> DataFrame:
    touched = commits.select(F.concat(F.lit("session:"), F.col("hash")).alias("src"), F.explode("files").alias("dst"))
    return touched.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", F.lit("touches").alias("type")).distinct()


def described(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes with descriptions that tell what they are, where, and how many edges come in."""
    inbound = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("inbound"))
    rows = nodes.join(inbound, "id", "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    area = top_area(F.col("path"))
    where = F.when(F.col("path").isNull() | (area == ROOT_AREA), F.lit("root")).otherwise(F.concat(F.lit("area '"), area, F.lit("'")))
    tail = F.when(F.col("inbound") > 0, F.concat(F.lit(" · "), F.col("inbound"), F.lit(" inbound"))).otherwise("")
    kind = F.col("kind")
    text = F.when(kind == "area", F.concat(F.lit("area '"), F.col("label"), F.lit("'"))).when(kind == "symbol", F.concat(F.coalesce("symbol", F.lit("symbol")), F.lit(" in "), F.col("path")))
    text = text.when(kind == "file", F.concat(F.coalesce("category", F.lit("file")), F.lit(" · "), where, tail)).when(kind == "decision", F.concat(F.lit("decision · "), F.col("inbound"), F.lit(" mentions")))
    return rows.withColumn("description", text.otherwise(F.col("description"))).drop("inbound")


@dataclass(frozen=True)
class Extracted:
    """The tables between corpus and graph."""

    corpus: DataFrame
    syntax: DataFrame
    specs: DataFrame
    refs: DataFrame
    decisions: DataFrame


def extracted(corpus: DataFrame) -> Extracted:
    texts = corpus.where(F.col("text").isNotNull()).withColumn("ext", F.lower(extension(F.col("path"))))
    docs = texts.where(F.col("ext").isin(*DOCUMENT_TYPES))
    scripts = texts.where(F.col("ext").isin(*SCRIPT_TYPES))
    specs = scripts.select(F.col("path").alias("file"), F.explode(extract.specifiers(F.col("text"))).alias("spec"))
    decisions = docs.select(F.col("path").alias("file"), F.explode(extract.decisions(F.col("text"))).alias("decision"))
    syntax = parsed(texts.where((F.col("ext") == ".py") | F.col("ext").isin(*sorted(SYMBOL_TYPES)))).persist()
    return Extracted(corpus, syntax, specs, document_references(docs), decisions)


def build_graph(corpus: DataFrame, project: str = "project", aliases: list[tuple[str, str]] = (), commits: DataFrame | None = None) -> Graph:
    """The graph of a corpus (path, size, text). Null paths are left out; of repeated paths one row counts."""
    corpus = corpus.where("path is not null").dropDuplicates(["path"])
    x = extracted(corpus)
    areas = area_nodes(corpus)
    ids = corpus.select(F.col("path").alias("id")).union(areas.select("id"))
    symbols = symbol_rows(x.syntax)
    refs = resolved_references(x.refs, corpus, ids).persist()
    first = first_definitions(symbols)
    mentions = x.decisions.select(F.col("file").alias("src"), F.concat(F.lit("decision:"), F.col("decision")).alias("dst"), F.lit("mentions").alias("type"))
    broken = refs.where("broken").groupBy(F.col("file").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda r: r["target"]).alias("broken_refs"))
    nodes = nodes_frame(file_nodes(corpus).join(broken, "id", "left")).union(nodes_frame(areas))
    nodes = nodes.union(nodes_frame(first.select("id", F.lit("symbol").alias("kind"), F.col("qualname").alias("label"), F.col("file").alias("path"), F.col("lineno").alias("line"), F.col("kind").alias("symbol"))))
    nodes = nodes.union(nodes_frame(x.decisions.select(F.concat(F.lit("decision:"), F.col("decision")).alias("id"), F.lit("decision").alias("kind"), F.col("decision").alias("label")).distinct()))
    edges = area_edges(corpus).union(first.select(F.col("file").alias("src"), F.col("id").alias("dst"), F.lit("defines").alias("type")))
    edges = edges.union(python_imports(x.syntax.select("file", F.inline("imports")), module_map(corpus)))
    edges = edges.union(script_imports(x.specs, ids, list(aliases), package_map(corpus)))
    edges = edges.union(refs.where("resolved is not null").select(F.col("file").alias("src"), F.col("resolved").alias("dst"), F.lit("references").alias("type")))
    edges = edges.union(mentions).union(call_edges(symbols)).union(wiring_edges(corpus, symbols))
    if commits is not None:
        nodes = nodes.union(nodes_frame(session_rows(commits)))
        edges = edges.union(session_edges(commits, nodes.select("id")))
    edges = edges_frame(edges).dropDuplicates(["src", "dst", "type"]).persist()
    found = graph_of(nodes, edges, project)
    out = Graph(nodes_frame(described(found.nodes, edges)), edges.select(*EDGE_COLUMNS), project).stored()
    for made in (x.syntax, refs, edges):
        made.unpersist()
    return out


def index(spark: SparkSession, root: str, project: str | None = None, sessions: bool = True) -> tuple[Graph, DataFrame]:
    """The graph and the manifest (path, sig) of a directory, from one listing and one reading of it."""
    from pathlib import Path

    from ..sources.aliases import load_aliases
    from ..sources.files import read_corpus
    from ..sources.history import commits

    corpus = read_corpus(spark, root).persist()
    log = commits(spark, root) if sessions else None
    graph = build_graph(corpus.select("path", "size", "text"), project or Path(root).resolve().name, load_aliases(root), log)
    return graph, corpus.where("sig is not null").select("path", "sig")

