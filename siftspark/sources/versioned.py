"""An atomic, versioned table of Parquet files: format("versioned"), for folders that every machine sees at the same path.

df.write.format("versioned").mode("append" or "overwrite").save(folder) makes a
version; spark.read.format("versioned").load(folder) reads the last one, option
version an earlier one. Tasks write files of their own; the version, one small
file that names them, comes last, and is linked into place, so it is there whole
or not at all. A task that fails, or a driver that dies, leaves the version
before as it was, and what was written beside it is removed, or never named. A
writer makes the version after that which it found when it began: of two that
found the same, the second is refused.

Each file's smallest and largest values are kept with the version, and a filter
that can't meet them leaves the file unread (where Spark pushes filters to Python
sources: spark.sql.python.filterPushdown.enabled). Versions are those of
operators.manifest, which can read them too.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage


class Conflict(RuntimeError):
    """Another writer has made this version."""


def _numbers(folder: str) -> list[int]:
    try:
        return sorted(int(n[:-5]) for n in os.listdir(os.path.join(folder, "versions")) if n.endswith(".json"))
    except FileNotFoundError:
        return []


def _version(folder: str, number: int | None = None) -> tuple[int, dict[str, Any]]:
    number = max(_numbers(folder), default=0) if number is None else number
    if number == 0:
        return 0, {"files": [], "schema": None}
    with open(os.path.join(folder, "versions", f"{number}.json"), encoding="utf-8") as f:
        return number, json.load(f)


def _plain(value: Any) -> Any:
    """A statistic as JSON has it; null for what isn't compared."""
    return value if isinstance(value, (int, float, str)) and not isinstance(value, bool) and value == value else None


def _ranges(path: str) -> dict[str, tuple]:
    """Smallest and largest value of each plain column of a file."""
    meta, out = pq.read_metadata(path), {}
    for i, name in enumerate(meta.schema.to_arrow_schema().names):
        stats = [meta.row_group(g).column(i).statistics for g in range(meta.num_row_groups)] if meta.num_columns == len(meta.schema.to_arrow_schema()) else []
        if stats and all(s is not None and s.has_min_max for s in stats):
            low, high = _plain(min(s.min for s in stats)), _plain(max(s.max for s in stats))
            if low is not None and high is not None:
                out[name] = (low, high)
    return out


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None, rows: int, ranges: dict[str, tuple]) -> None:
        self.name, self.rows, self.ranges = name, rows, ranges


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: T.StructType, overwrite: bool) -> None:
        self.folder, self.schema, self.overwrite = folder, schema.json(), overwrite
        self.base, self.old = _version(folder)
        for part in ("data", "versions"):
            os.makedirs(os.path.join(folder, part), exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        name, file, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        path = os.path.join(self.folder, "data", name)
        try:
            for batch in iterator:
                if batch.num_rows:
                    file = file or pq.ParquetWriter(path, batch.schema)
                    file.write_batch(batch)
                    rows += batch.num_rows
        except BaseException:
            if file is not None:
                file.close()
                os.remove(path)
            raise
        if file is None:
            return _Written(None, 0, {})
        file.close()
        return _Written(name, rows, _ranges(path))

    def commit(self, messages: list[_Written | None]) -> None:
        kept = [] if self.overwrite else self.old["files"]
        files = kept + [{"name": m.name, "rows": m.rows, "ranges": m.ranges} for m in messages if m is not None and m.name]
        aside = os.path.join(self.folder, "versions", f"{uuid.uuid4().hex}.part")
        with open(aside, "w", encoding="utf-8") as f:
            json.dump({"files": files, "schema": self.schema}, f)
        try:
            os.link(aside, os.path.join(self.folder, "versions", f"{self.base + 1}.json"))
        except FileExistsError:
            raise Conflict(f"version {self.base + 1} of {self.folder} is another writer's") from None
        finally:
            os.remove(aside)

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m is not None and m.name:
                os.remove(os.path.join(self.folder, "data", m.name))


def _may_hold(ranges: dict[str, Any], name: str, op: type, value: Any) -> bool:
    """Whether a file with these ranges can have a row that passes."""
    if name not in ranges:
        return True
    low, high = ranges[name]
    try:
        if op is In:
            return any(low <= v <= high for v in value)
        return {EqualTo: lambda: low <= value <= high, GreaterThan: lambda: high > value, GreaterThanOrEqual: lambda: high >= value, LessThan: lambda: low < value, LessThanOrEqual: lambda: low <= value}[op]()
    except TypeError:
        return True


class _Reader(DataSourceReader):
    def __init__(self, folder: str, version: int | None, schema: T.StructType) -> None:
        self.folder, self.version, self.names, self.tests = folder, version, schema.names, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In) and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], type(f), f.value))
            yield f  # files are left out by their ranges; rows are for Spark to test

    def partitions(self):
        files = _version(self.folder, self.version)[1]["files"]
        return [InputPartition(f["name"]) for f in files if all(_may_hold(f["ranges"], *t) for t in self.tests)]

    def read(self, partition):
        if partition is not None and partition.value is not None:
            yield from pq.ParquetFile(os.path.join(self.folder, "data", partition.value)).iter_batches(columns=self.names)


class Versioned(DataSource):
    """Option path: the folder; option version: which to read, the last by default."""

    @classmethod
    def name(cls) -> str:
        return "versioned"

    def schema(self) -> T.StructType:
        _, state = _version(self.options["path"], self._number())
        if state["schema"] is None:
            raise FileNotFoundError(f"no version in {self.options['path']}")
        return T.StructType.fromJson(json.loads(state["schema"]))

    def _number(self) -> int | None:
        return int(self.options["version"]) if "version" in self.options else None

    def reader(self, schema):
        return _Reader(self.options["path"], self._number(), schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Versioned)


def vacuum(folder: str, keep: int = 1) -> int:
    """Remove the files that none of the last `keep` versions names; how many went. Not to be called while a writer is at work."""
    used = {f["name"] for n in _numbers(folder)[-keep:] for f in _version(folder, n)[1]["files"]}
    gone = [n for n in os.listdir(os.path.join(folder, "data")) if n not in used]
    for n in gone:
        os.remove(os.path.join(folder, "data", n))
    return len(gone)
