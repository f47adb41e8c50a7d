"""Column expressions on POSIX relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^((?s:.*))/[^/]*$", 1)


def top_area(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("(root)"))


def extension(name: Column) -> Column:
    """With its dot, as it is written; names of leading dots alone have none."""
    return F.regexp_extract(basename(name), r"^\.*[^.](?s:.*?)(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    """What stands before the last dot; all of it without a dot."""
    return F.when(name.contains("."), F.regexp_extract(name, r"^((?s:.*))\.[^.]*$", 1)).otherwise(name)


def parents(path: Column) -> Column:
    """All directories above, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def normalised(path: Column) -> Column:
    """The path without empty parts, '.' and '..' where they can be resolved; '.' if nothing is left."""
    rooted = path.startswith("/")
    lead = F.when(path.rlike(r"^//(?!/)"), F.lit("//")).when(rooted, F.lit("/")).otherwise(F.lit(""))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when((F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.concat(done, F.array(part)))
        return F.when((part == "") | (part == "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    text = F.concat(lead, F.array_join(F.aggregate(F.split(path, "/"), none, step), "/"))
    return F.regexp_replace(text, r"\A\z", ".")  # the text stands here once, so it is worked out once


def joined(base: Column, target: Column) -> Column:
    """target seen from the directory base; an absolute target replaces it."""
    return F.when(target.startswith("/") | (base == ""), target).when(base.endswith("/"), F.concat(base, target)).otherwise(F.concat(base, F.lit("/"), target))
