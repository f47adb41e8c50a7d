"""Import aliases of script projects, from their configuration."""

from __future__ import annotations

import posixpath
import re
from json import loads
from pathlib import Path

Rules = list[tuple[str, str]]


def relaxed_json(text: str) -> dict:
    """JSON with comments and trailing commas; {} if it is none, or no object."""
    for pattern, by in ((r"(?s)/\*.*?\*/", ""), (r"//[^\n]*", ""), (r",(?=\s*[\]}])", "")):
        text = re.sub(pattern, by, text)
    try:
        got = loads(text)
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def alias_rules(config: dict, has_src: bool) -> Rules:
    """(prefix, directory or file), longest prefix first. Projects with a src directory have @/ and ~/ for it unless they say otherwise."""
    options = config.get("compilerOptions")
    options = options if isinstance(options, dict) else {}
    base = options.get("baseUrl")
    base = base if isinstance(base, str) else "."
    listed = options.get("paths")
    first = {name: next(iter(to), None) for name, to in listed.items() if isinstance(to, list)} if isinstance(listed, dict) else {}
    known: dict[str, str] = {}
    for name, to in first.items():
        # a star may only stand at the very end, and on both sides
        ends = (name[-2:], to[-2:]) if isinstance(to, str) else ()
        cut = 1 if ends == ("/*", "/*") else 0
        if ends and "*" not in name[: len(name) - cut] + to[: len(to) - cut]:
            known[name[: len(name) - cut]] = posixpath.normpath(posixpath.join(base, to[: len(to) - cut]))
    usual = {"@/": "src", "~/": "src"} if has_src else {}
    return sorted((usual | known).items(), key=lambda rule: (-len(rule[0]), rule[0] in usual))


def load_aliases(root: str | Path) -> Rules:
    root = Path(root)
    config: dict = {}
    for name in ("tsconfig.json", "jsconfig.json"):
        f = root / name
        if not config and f.is_file():
            config = relaxed_json(f.read_text("utf-8", "ignore"))
    return alias_rules(config, (root / "src").is_dir())
