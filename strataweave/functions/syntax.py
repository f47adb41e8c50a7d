"""Symbols, calls and imports of source texts. Syntax trees are opaque to SQL, so this runs in Python workers on Arrow batches."""

from __future__ import annotations

import ast
from importlib.util import find_spec

import pyarrow as pa
from pyspark.sql import DataFrame

SYMBOLS = "array<struct<name:string,qualname:string,kind:string,lineno:int,calls:array<string>>>"
IMPORTS = "array<struct<level:int,module:string,names:array<string>>>"
SCHEMA = f"file string, symbols {SYMBOLS}, imports {IMPORTS}"
_SYMBOL_TYPE = pa.list_(pa.struct([("name", pa.string()), ("qualname", pa.string()), ("kind", pa.string()), ("lineno", pa.int32()), ("calls", pa.list_(pa.string()))]))
_IMPORT_TYPE = pa.list_(pa.struct([("level", pa.int32()), ("module", pa.string()), ("names", pa.list_(pa.string()))]))

#: Definitions and calls by language of the optional grammars: node type -> kind of symbol, and node types of calls.
GRAMMARS = {
    language: ({t: "class" for t in classes.split()} | {t: "function" for t in routines.split()}, set(calls.split()))
    for language, classes, routines, calls in (
        ("javascript", "class_declaration", "function_declaration generator_function_declaration method_definition", "call_expression new_expression"),
        ("go", "type_spec", "function_declaration method_declaration", "call_expression"),
        ("rust", "enum_item struct_item trait_item", "function_item", "call_expression macro_invocation"),
        ("java", "class_declaration enum_declaration interface_declaration", "constructor_declaration method_declaration", "method_invocation object_creation_expression"),
        ("php", "class_declaration interface_declaration trait_declaration", "function_definition method_declaration", "function_call_expression member_call_expression object_creation_expression scoped_call_expression"),
    )
}
GRAMMARS["typescript"] = GRAMMARS["tsx"] = (GRAMMARS["javascript"][0] | {"abstract_class_declaration": "class", "interface_declaration": "class"}, GRAMMARS["javascript"][1])
LANGUAGES = {f".{end}": language for language, ends in (("go", "go"), ("java", "java"), ("javascript", "cjs js jsx mjs"), ("php", "php"), ("rust", "rs"), ("tsx", "tsx"), ("typescript", "ts")) for end in ends.split()}
SYMBOL_TYPES = {*LANGUAGES, ".vue"}


def grammars_there() -> bool:
    return find_spec("tree_sitter_language_pack") is not None


def _calls(node: ast.AST, skip: set[int]) -> list[str]:
    """Names called below a node, first seen first; subtrees in skip belong to other symbols."""
    seen: dict[str, None] = {}
    stack = [*ast.iter_child_nodes(node)][::-1]
    while stack:
        child = stack.pop()
        if id(child) not in skip:
            called = getattr(child, "func", None) if type(child) is ast.Call else None
            name = getattr(called, "id", None) or getattr(called, "attr", None)
            if name:
                seen.setdefault(name)
            stack.extend([*ast.iter_child_nodes(child)][::-1])
    return list(seen)


def python_module(source: str) -> tuple[list[dict], list[dict]]:
    """(symbols, imports) at the top level: functions, classes and their methods. A text that can't be parsed has none."""
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []
    routine = ast.FunctionDef | ast.AsyncFunctionDef
    symbols, imports = [], []

    def add(node, kind, prefix="", skip=()):
        symbols.append({"name": node.name, "qualname": prefix + node.name, "kind": kind, "lineno": node.lineno, "calls": _calls(node, {id(s) for s in skip})})

    for node in body:
        match node:
            case ast.Import():
                imports += [{"level": 0, "module": a.name, "names": []} for a in node.names]
            case ast.ImportFrom():
                imports.append({"level": node.level or 0, "module": node.module, "names": [a.name for a in node.names]})
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                add(node, "function")
            case ast.ClassDef():
                inner = [m for m in node.body if isinstance(m, routine)]
                add(node, "class", skip=inner)
                for m in inner:
                    add(m, "function", f"{node.name}.")
    return symbols, imports


def grammar_symbols(language: str, source: str, first_line: int = 1) -> list[dict]:
    """Symbols by the grammar of a language, nested names joined by dots; none if the grammar fails."""
    from tree_sitter_language_pack import get_parser

    kinds, calls = GRAMMARS[language]
    data = source.encode()
    try:
        root = get_parser(language).parse(data).root_node
    except Exception:  # a grammar that can't be loaded or fails means no symbols for this text, as if it weren't installed
        return []
    text = lambda n: data[n.start_byte : n.end_byte].decode(errors="replace")
    out: list[dict] = []
    stack: list[tuple] = [(root, [])]
    while stack:
        node, above = stack.pop()
        name = node.child_by_field_name("name") if node.type in kinds else None
        if name is not None:
            symbol = {"name": text(name), "qualname": ".".join([*(s["name"] for s in above), text(name)]), "kind": kinds[node.type], "lineno": node.start_point[0] + first_line, "calls": []}
            out.append(symbol)
            above = [*above, symbol]
        if node.type in calls and above:
            callee = next((c for f in ("name", "function", "constructor", "type", "macro") if (c := node.child_by_field_name(f)) is not None), node.children[-1] if node.children else None)
            while callee is not None and callee.named_children:
                callee = next((c for c in reversed(callee.named_children) if "identifier" in c.type or c.type == "name" or c.named_children), None)
            if callee is not None and text(callee) not in above[-1]["calls"]:
                above[-1]["calls"].append(text(callee))
        stack.extend((c, above) for c in reversed(node.children))
    return out


def symbols_of(ext: str, source: str) -> list[dict]:
    """Symbols of a text that isn't Python; scripts inside Vue pages count with the lines of the page."""
    import re

    if ext != ".vue":
        return grammar_symbols(LANGUAGES[ext], source)
    out = []
    for m in re.finditer(r"(?is)<script\b([^>]*)>((?:.)*?)<[/]script>", source):
        typed = re.search(r"(?i)lang\s*=\s*[\"']tsx?[\"']", m[1])
        out += grammar_symbols("typescript" if typed else "javascript", m[2], 1 + source[: m.start(2)].count("\n"))
    return out


def parsed(corpus: DataFrame) -> DataFrame:
    """file, symbols, imports of the rows of (path, ext, text); other languages than Python have symbols only if their grammars are installed."""

    def run(batches):
        grammars = grammars_there()
        for batch in batches:
            found = []
            for ext, text in zip(batch["ext"].to_pylist(), batch["text"].to_pylist()):
                if ext == ".py":
                    found.append(python_module(text or ""))
                else:
                    found.append((symbols_of(ext, text or "") if grammars and ext in SYMBOL_TYPES else [], []))
            yield pa.record_batch([batch["path"], pa.array([s for s, _ in found], _SYMBOL_TYPE), pa.array([i for _, i in found], _IMPORT_TYPE)], names=["file", "symbols", "imports"])

    # a small file is one task, however long its texts take to parse
    spark = corpus.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return corpus.select("path", "ext", "text").repartition(tasks, "path").mapInArrow(run, SCHEMA)
