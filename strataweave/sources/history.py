"""Git history as tables; without git or a repository they are empty."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "hash string, subject string, date string, author string, files array<string>"
COMMIT_LIMIT = 40
_RECORD, _UNIT = "\x1e", "\x1f"


def _git(root: str, *args: str) -> str:
    if not os.path.exists(os.path.join(root, ".git")):
        return ""
    try:
        got = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], capture_output=True, timeout=20, check=True)
    except (OSError, subprocess.SubprocessError):
        return ""
    return got.stdout.decode("utf-8", "replace")


def git_log(root: str | os.PathLike, limit: int = COMMIT_LIMIT) -> str:
    shape = "%x1e%h%x1f%s%x1f%aI%x1f%an"
    return _git(os.fspath(root), "log", "--name-only", "--no-merges", f"-{max(1, limit)}", f"--pretty=format:{shape}")


def parsed_log(log: Column) -> Column:
    """Array of commits of a log text."""
    records = F.filter(F.transform(F.split(log, _RECORD), lambda r: F.regexp_replace(r, r"^\n+|\n+$", "")), lambda r: r != "")

    def commit(r: Column) -> Column:
        head = F.split(F.substring_index(r, "\n", 1), _UNIT)
        field = lambda k: F.coalesce(F.get(head, F.lit(k)), F.lit(""))
        body = F.locate("\n", r)
        files = F.when(body > 0, F.filter(F.transform(F.split(F.substring(r, body + 1, F.char_length(r)), "\n"), F.trim), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
        return F.struct(field(0).alias("hash"), field(1).alias("subject"), field(2).alias("date"), field(3).alias("author"), files.alias("files"))

    return F.filter(F.transform(records, commit), lambda c: c["hash"] != "")


def commits(spark: SparkSession, root: str | os.PathLike, limit: int = COMMIT_LIMIT) -> DataFrame:
    """The latest commits that aren't merges."""
    log = spark.createDataFrame([(git_log(root, limit),)], "log string")
    return log.select(F.inline(parsed_log(F.col("log"))))


def changed_files(root: str | os.PathLike, since="HEAD") -> list[str]:
    """Paths whose working copy differs from a commit."""
    return [x.strip() for x in _git(os.fspath(root), "diff", since, "--name-only").splitlines() if x.strip()]
