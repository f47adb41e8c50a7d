"""What a path says about a file: its category and its architectural layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename, extension, stem

CODE = {f".{x}" for x in "bash c cc cjs cpp cs go h hpp java js jsx kt lua mjs php ps1 psm1 py rb rs scala sh sql swift ts tsx vue".split()}
DATA = {f".{x}" for x in "csv db duckdb jsonl ndjson parquet sqlite sqlite3 tsv".split()}
CONFIG = {f".{x}" for x in "cfg conf env ini json properties toml xml yaml yml".split()}
DOCUMENT = {f".{x}" for x in "adoc docx htm html markdown md pdf rst txt".split()}
STRUCTURE_NAMES = set("architecture.md authors changelog.md contributing.md index.md license license.md notice readme readme.md readme.rst".split())
CONFIG_NAMES = set("caddyfile dockerfile makefile .editorconfig .gitignore .graphignore".split())

#: In the order in which they are tried; the first whose words meet those of a path is its layer.
LAYER_WORDS = (
    ("entrypoint", "__main__ app cli cmd main manage server"),
    ("api", "api controller controllers endpoint endpoints graphql handler handlers http rest route routes web"),
    ("ui", "component components frontend page pages styles template templates ui view views widget widgets"),
    ("data", "dao database db entities entity migration migrations model models orm repositories repository schema schemas store stores"),
    ("service", "domain logic manager managers provider providers service services usecase usecases worker workers"),
    ("util", "common helper helpers lib libs shared support tool tools util utils"),
)
_PLACE_OF = {word: k + 1 for k, (_, words) in reversed([*enumerate(LAYER_WORDS)]) for word in words.split()}
_LAYER_PLACE = [x for pair in _PLACE_OF.items() for x in pair]
_LAYER_WORD = f"(?<=/)(?:{'|'.join(sorted(_PLACE_OF))})(?=/)"


def category(path: Column) -> Column:
    """One of CATEGORIES for each path."""
    low = F.lower(path)
    name, ext = basename(low), extension(low)
    return (
        F.when(name.startswith("memory.") | F.array_contains(F.split(low, "/"), "memory"), "memory")
        .when(ext.isin(*sorted(CODE)), "code")
        .when(ext.isin(*sorted(DATA)), "data")
        .when(name.isin(*sorted(STRUCTURE_NAMES)), "structure")
        .when(name.isin(*sorted(CONFIG_NAMES)) | ext.isin(*sorted(CONFIG)), "config")
        .when((ext == "") | ext.isin(*sorted(DOCUMENT)), "doc")
        .otherwise("config")
    )


def layer(kind: Column, path: Column, cat: Column) -> Column:
    """One of LAYERS; nodes that aren't files, and those without a path, are 'other'."""
    low, slash = F.lower(path), F.lit("/")
    own = stem(basename(low))
    words = F.concat(slash, low, slash, own, slash, F.translate(own, "-_", "//"), slash)
    out = F.when((kind != "file") | path.isNull() | (path == ""), "other")
    out = out.when(F.concat(slash, low, slash).rlike("/tests?/") | own.startswith("test_") | own.endswith("_test"), "tests")
    out = out.when(cat == "data", "data").when(cat == "config", "config").when(cat.isin("doc", "memory", "structure"), "docs")
    # one search for all words: a chain of conditions would split the path again for each
    places = F.transform(F.regexp_extract_all(words, F.lit(_LAYER_WORD), F.lit(0)), lambda w: F.element_at(F.create_map(*[F.lit(x) for x in _LAYER_PLACE]), w))
    names = F.array(*[F.lit(name) for name, _ in LAYER_WORDS], F.lit("core"))
    return out.otherwise(F.element_at(names, F.coalesce(F.array_min(places), F.lit(len(LAYER_WORDS) + 1))))
