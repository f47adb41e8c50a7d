"""Files of a project as a corpus: path, size, mtime_ns, text and signature, read once for graph and manifest alike."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from fnmatch import fnmatchcase, translate
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, extension

IGNORE_FILE = ".graphignore"
READ_LIMIT, DIGEST_LIMIT = 5_000_000, 1_000_000
SKIP_DIRS = set("__pycache__ .cache .eggs .git .hg .idea .mypy_cache .next .nuxt .pytest_cache .ruff_cache .strataweave .svn .tox .venv .vscode build dist env node_modules site-packages target venv".split())
SKIP_FILES = {".DS_Store", IGNORE_FILE, "Thumbs.db", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "yarn.lock"}
SKIP_TYPES = {f".{x}" for x in "7z a bin bmp dll dylib eot exe gif gz ico jpeg jpg lock o png pyc pyd pyo rar so tar ttf webp woff woff2 zip".split()}
READ_TYPES = {f".{x}" for x in "adoc cjs go htm html java js jsx markdown md mjs php py rs rst ts tsx txt vue".split()}
DIGEST_TYPES = {f".{x}" for x in "adoc bash c cc cfg cjs conf cpp cs css go h hpp htm html ini java js jsx markdown md mjs php ps1 psm1 py rb rs rst sh sql toml ts tsx txt vue yaml yml".split()}
CORPUS_SCHEMA = "path string, size bigint, mtime_ns bigint, text string, sig string"


def _type(file: str) -> str:
    return os.path.splitext(file)[-1].lower()


def ignore_globs(root: str | Path) -> list[str]:
    """Patterns of the ignore file, one a line; lines that begin with # are comments."""
    f = Path(root) / IGNORE_FILE
    lines = f.read_text("utf-8", "ignore").splitlines() if f.is_file() else []
    return [x for x in map(str.strip, lines) if x and x[0] != "#"]


def _skips_dir(name: str) -> bool:
    return name in SKIP_DIRS or name.endswith(".egg-info")


def _skips_file(rel: str, globs: list[str]) -> bool:
    name = rel.rpartition("/")[2]
    return name in SKIP_FILES or _type(name) in SKIP_TYPES or any(fnmatchcase(x, g) for g in globs for x in (rel, name))


def git_files(root: str | Path) -> list[str] | None:
    """What git tracks or would show as new; None without git or a repository."""
    try:
        got = subprocess.run(["git", "-C", os.fspath(root), "ls-files", "-z", "--exclude-standard", "--others", "--cached"], capture_output=True, timeout=30, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return [os.fsdecode(x) for x in got.stdout.split(b"\0") if x]


def list_files(root: str | Path) -> list[str]:
    """Sorted relative paths of the files worth indexing, by git where there is a repository."""
    root, globs = Path(root), ignore_globs(root)
    known = git_files(root)
    if known is not None:
        ok = [r for r in known if not any(map(_skips_dir, r.split("/")[:-1])) and ((root / r).is_symlink() or (root / r).is_file())]
    else:
        ok = []
        for at, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if not _skips_dir(d)]
            ok += [(Path(at) / n).relative_to(root).as_posix() for n in names]
    return sorted({r for r in ok if not _skips_file(r, globs)})


def digest(raw: bytes) -> str:
    """Of the content with line ends made alike."""
    return "c:" + hashlib.blake2b(re.sub(rb"\r\n?", b"\n", raw), digest_size=12).hexdigest()


def read_corpus(spark: SparkSession, root: str | Path, paths: list[str] | None = None) -> DataFrame:
    """The corpus of a directory that all executors can read. Contents are read there, and only of files that are parsed or digested."""
    base = os.fspath(Path(root).resolve())
    if not os.path.isdir(base):
        raise NotADirectoryError(base)
    names = list_files(base) if paths is None else paths

    def read(batches):
        for batch in batches:
            rows = []
            for rel in batch["path"].to_pylist():
                size = mtime = text = sig = None
                try:
                    st = os.stat(os.path.join(base, rel))
                    size, mtime = st.st_size, st.st_mtime_ns
                    sig = f"d:{size}-{mtime}"
                    kind = _type(rel)
                    hashed = kind in DIGEST_TYPES and size <= DIGEST_LIMIT
                    name = rel.rpartition("/")[2]
                    parsed = (kind in READ_TYPES or name == "package.json") and size <= READ_LIMIT
                    if hashed or parsed:
                        sig = None if hashed else sig
                        with open(os.path.join(base, rel), "rb") as f:
                            raw = f.read()
                        sig = digest(raw) if hashed else sig
                        text = raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") if parsed else None
                except OSError:
                    pass
                rows.append((rel, size, mtime, text, sig))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["path", "size", "mtime_ns", "text", "sig"])

    parts = max(1, min(len(names) // 64, 10_000))
    return spark.createDataFrame([(n,) for n in names], "path string").repartition(parts).mapInArrow(read, CORPUS_SCHEMA)


def skipped(path: Column, globs: list[str] = ()) -> Column:
    """The built-in rules and glob patterns as an expression, for listings that are tables already."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = basename(path)
    out = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in sorted(SKIP_DIRS)])) | F.exists(dirs, lambda d: d.endswith(".egg-info"))
    out = out | name.isin(*sorted(SKIP_FILES)) | F.lower(extension(path)).isin(*sorted(SKIP_TYPES))
    for g in globs:
        pattern = "^" + re.sub(r"\\Z$|\\z$", "$", translate(g).replace("(?s:", "(?s:"))
        out = out | path.rlike(pattern) | name.rlike(pattern)
    return out


def scan_store(spark: SparkSession, url: str, globs: list[str] = ()) -> DataFrame:
    """The corpus of any store that Spark can list, by the binary file source; contents are read only where they are parsed."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(url)
    base = url.rstrip("/")
    rel = F.regexp_replace(F.expr(f"substring(path, locate('{base}', path) + {len(base) + 1})"), "^/+", "")
    raw = raw.withColumn("rel", rel).where(~skipped(F.col("rel"), globs))
    kind = F.lower(extension(F.col("rel")))
    text = F.when((kind.isin(*sorted(READ_TYPES)) | (basename(F.col("rel")) == "package.json")) & (F.col("length") <= READ_LIMIT), F.regexp_replace(F.decode("content", "UTF-8"), "�", ""))
    hashed = kind.isin(*sorted(DIGEST_TYPES)) & (F.col("length") <= DIGEST_LIMIT)
    mtime = (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")
    sig = F.when(hashed, F.concat(F.lit("s:"), F.sha2(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n?", "\n"), 256))).otherwise(F.concat(F.lit("d:"), F.col("length"), F.lit("-"), F.unix_micros("modificationTime") * 1000))
    return raw.select(F.col("rel").alias("path"), F.col("length").alias("size"), mtime, text.alias("text"), sig.alias("sig"))


def signature(path: Column, size: Column, mtime_ns: Column, text: Column) -> Column:
    """A signature by built-in functions for corpora that are tables: of the text with line ends made alike, or of size and time."""
    hashed = F.lower(extension(path)).isin(*sorted(DIGEST_TYPES)) & text.isNotNull() & (F.octet_length(text) <= DIGEST_LIMIT)
    return F.when(hashed, F.concat(F.lit("s:"), F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256))).otherwise(F.concat(F.lit("d:"), size.cast("string"), F.lit("-"), mtime_ns.cast("string")))
