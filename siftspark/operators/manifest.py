"""Versions of what lies in a folder: one small file each.

A version's file is created exclusively, which HDFS and local file systems do
atomically: of two writers that started from the same version, one is refused.
Readers take the last version whose file is whole; what a writer leaves behind
without one is never read. A writer that died within its few bytes keeps its
number; repair() gives it back.
"""

from __future__ import annotations

import json
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made this version."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names(spark, f"{folder}/versions") if n.endswith(".json") and n[:-5].isdigit())


def _load(spark: SparkSession, folder: str, version: int) -> dict[str, Any] | None:
    """What a version holds; null if its file isn't whole."""
    p, fs = _path(spark, f"{folder}/versions/{version}.json")
    file = fs.open(p)
    try:
        text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(file)).decode()
    finally:
        file.close()
    return json.loads(text) if text.endswith("}") else None


def read(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, dict[str, Any]]:
    """(version, what it holds), by default of the last; (0, {}) where there is none."""
    for n in reversed(_numbers(spark, folder)) if version is None else [version]:
        if (found := _load(spark, folder, n)) is not None:
            return n, found
    return 0, {}


def commit(spark: SparkSession, folder: str, version: int, content: dict[str, Any]) -> None:
    """Make a version, the one after that which the writer has read."""
    p, fs = _path(spark, f"{folder}/versions/{version}.json")
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "exist" in str(e.java_exception).lower():
            raise Conflict(f"version {version} of {folder} is another writer's") from None
        raise
    out.write(bytearray(json.dumps(content).encode()))
    out.close()


def repair(spark: SparkSession, folder: str) -> list[int]:
    """Give back the numbers of writers that died within their version's file; to be called while none writes."""
    broken = [n for n in _numbers(spark, folder) if _load(spark, folder, n) is None]
    for n in broken:
        remove(spark, f"{folder}/versions/{n}.json")
    return broken


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)
