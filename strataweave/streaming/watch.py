"""Keeping a stored graph fresh: a rebuild when, and only when, the manifest differs.

File streams see neither deletions nor overwriting, so the difference of manifests decides; a stream only says when to look.
"""

from __future__ import annotations

import subprocess
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import MANIFEST_SCHEMA
from ..plans.build import index
from ..plans.gate import diff_manifest, manifest_of
from ..sources import store
from ..sources.files import read_corpus

MIN_INTERVAL = 0.2
HOOK = "post-commit"
OURS = "# strataweave: builds the graph anew after a commit"
OnChange = Callable[[DataFrame], None]


def tell(changes: DataFrame) -> None:
    print(", ".join(f"{r['count']} {r['change']}" for r in changes.groupBy("change").count().orderBy("change").collect()))


def refresh_if_changed(spark: SparkSession, root: str) -> DataFrame | None:
    """path and change since the stored manifest, if there is any: then the graph is built and stored anew. Without a stored one all is new."""
    old = store.load_manifest(spark, root)
    changes = diff_manifest(spark.createDataFrame([], MANIFEST_SCHEMA) if old is None else old, manifest_of(read_corpus(spark, root))).persist()
    if old is not None and changes.isEmpty():
        changes.unpersist()
        return None
    changes.count()  # the files may change again
    store.save(root, *index(spark, root))
    return changes


def watch(spark: SparkSession, root: str, interval: float = 2.0, on_change: OnChange = tell, rounds: int | None = None) -> None:
    """Looks again and again; rounds limits how often."""
    while rounds is None or rounds > 0:
        got = refresh_if_changed(spark, root)
        if got is not None:
            on_change(got)
            got.unpersist()
        rounds = None if rounds is None else rounds - 1
        if rounds != 0:
            time.sleep(max(MIN_INTERVAL, interval))


def watch_stream(spark: SparkSession, root: str, on_change: OnChange = tell, seconds: int = 2) -> StreamingQuery:
    """The same as a streaming query that ticks; stop() ends it."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: watch(spark, root, 0, on_change, 1)).trigger(processingTime=f"{max(1, seconds)} seconds").start()


def install_hook(root: str, command: str = "python -m strataweave.cli build") -> Path:
    """Has git build the graph after each commit. A hook of somebody else is left alone (FileExistsError); outside a repository: FileNotFoundError."""
    asked = subprocess.run(["git", "-C", root, "rev-parse", "--git-path", f"hooks/{HOOK}"], capture_output=True, text=True)
    if asked.returncode or not (Path(root) / ".git").exists():
        raise FileNotFoundError(f"{root} is not the top of a git repository")
    hook = Path(root) / asked.stdout.strip()
    if hook.exists() and OURS not in hook.read_text("utf-8", "replace").splitlines():
        raise FileExistsError(f"{hook} is somebody else's")
    hook.parent.mkdir(parents=True, exist_ok=True)
    hook.write_text(f"#!/bin/sh\n{OURS}\n({command} --root . >/dev/null 2>&1; true)\n", "utf-8")
    hook.chmod(0o755)
    return hook
