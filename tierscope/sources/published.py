"""Versioned folders that a reader only ever sees whole.

``publish`` writes into a folder of its own and commits it by creating one empty
file whose name carries the number and the folder; creating a file is a single
step on HDFS, local disks and object stores. Readers take the folder of the
largest commit, so they see the old set or the new one, never a mixture, and a
writer that dies leaves an uncommitted folder which the next one removes. There
is one writer at a time for each root.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

KEEP = 2  # committed versions that stay for readers which have begun with them


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def _commits(spark: SparkSession, root: str) -> list[tuple[int, str, str]]:
    """``(number, label, version)`` of every commit, oldest first."""
    parts = (n.split("~") for n in _names(spark, f"{root}/_commits") if n.count("~") == 2)
    return sorted((int(k), label, version) for k, label, version in parts)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the last commit, or None."""
    commits = _commits(spark, root.rstrip("/"))
    return f"{root.rstrip('/')}/{commits[-1][2]}" if commits else None


def current_label(spark: SparkSession, root: str) -> str | None:
    """What the writer of the last commit named it (a batch number, say)."""
    commits = _commits(spark, root.rstrip("/"))
    return commits[-1][1] if commits else None


def publish(spark: SparkSession, root: str, write: Callable[[str], None], label: str = "",
            keep: int = KEEP) -> str:
    """Let ``write(folder)`` fill a new version, then switch readers to it.

    If ``write`` fails nothing is committed. Versions behind the last ``keep``
    commits, and folders that were never committed, are removed first, so that
    readers of the last versions aren't disturbed.
    """
    if "~" in label or "/" in label:
        raise ValueError("a label can't hold ~ or /")
    root = root.rstrip("/")
    commits = _commits(spark, root)
    _sweep(spark, root, commits, keep)
    number = commits[-1][0] + 1 if commits else 1
    version = f"v{number:09d}-{uuid.uuid4().hex[:12]}"
    write(f"{root}/{version}")
    fs, p = _fs(spark, f"{root}/_commits/{number:09d}~{label}~{version}")
    fs.mkdirs(p.getParent())
    if not fs.createNewFile(p):
        raise RuntimeError(f"{p} exists: another writer publishes to {root}")
    return f"{root}/{version}"


def _sweep(spark: SparkSession, root: str, commits: list[tuple[int, str, str]], keep: int) -> None:
    kept = commits[-keep:]
    for number, label, version in commits[:-keep]:
        fs, p = _fs(spark, f"{root}/_commits/{number:09d}~{label}~{version}")
        fs.delete(p, False)
    live = {version for _, _, version in kept}
    for name in _names(spark, root):
        if name.startswith("v") and name not in live:
            fs, p = _fs(spark, f"{root}/{name}")
            fs.delete(p, True)
