"""What a compact row of a node costs a reader, in tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimated(text: Column) -> Column:
    """A token for each four characters, halves to even, one at least."""
    return F.greatest(F.lit(1), F.bround(F.char_length(text) / F.lit(4.0)).cast("int"))


def quoted(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, everything else as it is."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')
    for raw, name in (("\n", "n"), ("\t", "t"), ("\r", "r"), ("\b", "b"), ("\f", "f")):
        plain = F.replace(plain, F.lit(raw), F.lit("\\" + name))
    rare = [chr(c) for c in range(32) if chr(c) not in "\n\t\r\b\f"]
    escaped = plain
    for raw in rare:
        escaped = F.replace(escaped, F.lit(raw), F.lit(f"\\u{ord(raw):04x}"))
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def compact_row(node_id: Column, kind: Column, category: Column, size: Column, line: Column, degree: Column) -> Column:
    """The row as JSON with a blank behind commas and colons; null values of kind-specific fields are left out."""
    nothing = F.lit("")
    return F.concat(
        F.lit('{"id": '), quoted(node_id), F.lit(', "kind": '), quoted(kind),
        F.when(category.isNotNull() & (category != ""), F.concat(F.lit(', "cat": '), quoted(category))).otherwise(nothing),
        F.when(kind == "file", F.concat(F.lit(', "size": '), F.coalesce(size, F.lit(0)).cast("string"))).otherwise(nothing),
        F.when((kind == "symbol") & (F.coalesce(line, F.lit(0)) != 0), F.concat(F.lit(', "line": '), line.cast("string"))).otherwise(nothing),
        F.lit(', "deg": '), degree.cast("string"), F.lit("}"),
    )


def human_size(n: float) -> str:
    """1024-step units; bytes without decimals."""
    power = 0
    while n >= 1024 and power < 4:
        n, power = n / 1024, power + 1
    return f"{n:.{min(power, 1)}f} {'B KB MB GB TB'.split()[power]}"
