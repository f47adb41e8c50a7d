"""What texts refer to: column expressions over regular expressions of bounded length, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE_TYPES = "adoc bash c cc cpp cs csv cfg db docx duckdb go h hpp html htm ini java json jsonl js jsx conf cjs markdown md mjs parquet pdf php ps1 psm1 py rb rs rst sh sqlite sql toml tsv tsx ts txt vue xml yaml yml".split()
REF_STRUCT = "array<struct<target:string,kind:string>>"

_URL = r"(?i)^(?U:\s*)(?:mailto:|(?:[a-z][-+.a-z0-9]*:)?//)"
_LINK = r"(?U)\]\(\s*<?([^\s>)]+)>?[^)]*\)"
_WIKI = r"\[\[([^\]\[\n]{1,300})\]\]"
_PATH = r"(?U)(?<![-\w./\\])([0-9A-Za-z_][-\w./\\]*\.[0-9A-Za-z]{1,8})\b"
_ATTRIBUTE = r"""(?iU)(?:src|href)\s*=\s*['"]([^\s>'"]{1,300})"""
_DECISION = r"(?U)\b((?:ADR-|RFC-|D-[A-Z]{1,8}-)\d{1,5})\b"
_SPECIFIER = r"""(?U)(?:require\(\s*|export\s[^"']*?from\s*|import\s[^"']*?from\s*|import\s*)["']([^"']+)["']"""
_CLASS = r"(?U)\b([A-Z_a-z]\w*)::class\b"
_LISTEN = r"(?U)\b([A-Z_a-z]\w*)::class\s*=>[\s]*\[([^]]*)]"


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normal_target(raw: Column) -> Column:
    """Without code marks, anchor and query, with forward slashes."""
    bare = stripped(F.regexp_replace(stripped(raw), r"^`+|`+$", ""))
    whole = stripped(F.translate(F.regexp_extract(bare, r"^([^#?]*)", 1), "\\", "/"))
    return F.when(raw.rlike(r"(?U)[\s`#?\\]"), whole).otherwise(raw)  # most need one search instead of five


def has_reference_type(token: Column) -> Column:
    base = F.regexp_extract(token, r"^([^#?]*)", 1)
    return base.contains(".") & F.lower(F.substring_index(base, ".", -1)).isin(*REFERENCE_TYPES)


def _as(kind: str, targets: Column) -> Column:
    return F.transform(targets, lambda t: F.struct(t.alias("target"), F.lit(kind).alias("kind")))


def path_tokens(text: Column) -> Column:
    """Everything in prose that has the shape of a path, whatever its extension."""
    return every(text, _PATH)


def references(text: Column, html: Column) -> Column:
    """Array of (target, kind) in the order of kinds, then of the text; repeated targets are still in it, URLs aren't."""
    wiki = F.filter(F.transform(every(text, _WIKI), lambda t: stripped(F.substring_index(F.substring_index(t, "|", 1), "#", 1))), lambda t: t != "")
    paths = F.filter(path_tokens(text), lambda t: F.lower(F.substring_index(t, ".", -1)).isin(*REFERENCE_TYPES))
    prose = F.concat(_as("link", every(text, _LINK)), _as("wikilink", wiki), _as("path", paths))
    page = _as("link", F.filter(every(text, _ATTRIBUTE), has_reference_type))
    found = F.filter(F.when(html, page).otherwise(prose), lambda r: ~r["target"].rlike(_URL))
    found = F.transform(found, lambda r: F.struct(normal_target(r["target"]).alias("target"), r["kind"].alias("kind")))
    return F.filter(found, lambda r: r["target"] != "").cast(REF_STRUCT)


def attribute_targets(text: Column) -> Column:
    """All href and src values of a page, whatever they name."""
    return every(text, _ATTRIBUTE)


def decisions(text: Column) -> Column:
    return F.array_distinct(every(text, _DECISION))


def specifiers(text: Column) -> Column:
    """What scripts import, as it is written."""
    return F.array_distinct(every(text, _SPECIFIER))


def class_names(text: Column) -> Column:
    return F.array_distinct(every(text, _CLASS))


def listener_pairs(text: Column) -> Column:
    """Array of (event, listeners); events without listeners aren't in it."""
    both = F.arrays_zip(every(text, _LISTEN, 1).alias("event"), F.transform(every(text, _LISTEN, 2), class_names).alias("listeners"))
    return F.filter(both, lambda p: F.size(p["listeners"]) > 0)


def is_route_file(path: Column) -> Column:
    parts = F.split(path, "/")
    return path.endswith(".php") & F.array_contains(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "routes")


def is_event_provider(path: Column) -> Column:
    return F.substring_index(path, "/", -1) == "EventServiceProvider.php"
