"""Captured payloads: spark.read.format("captured").load(folder), or captures() with what couldn't be read.

A folder holds JSON-lines files of captures: {"source_id", "recipe", "url", "body"}. captures() reads them
through Spark's own readers, from any store; the data source is for a folder that every machine sees at the
same path.
"""

from __future__ import annotations

import json
import os
import time
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from . import listings, markup

SCHEMA = "source_id string, recipe string, url string, body string"


def captures(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(captures, malformed lines by file) of all files under a folder."""
    lines = spark.read.text(folder).select(F.col("_metadata.file_path").alias("file"), "value").where("trim(value) <> ''")
    read = lines.select("file", F.from_json("value", SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    ok = F.col("r").isNotNull() & F.col("r._bad").isNull()
    return read.where(ok).select("r.source_id", "r.recipe", "r.url", "r.body"), read.where(~ok).groupBy("file").agg(F.count("*").alias("malformed"))


def _feed(rows: DataFrame) -> DataFrame:
    return rows.select("source_id", F.inline(markup.parse_feed("body", "url"))).select("source_id", "rank", "ok", "url", "title", "published_at", "summary")


def _posts(field: str, limit: int | None = None):
    return lambda rows: listings.posts(rows, field, limit=limit, base="https://posts.example.org").select("source_id", "rank", "ok", "url", "title", "published_at", "summary")


#: How the captures of a recipe become items: source_id, rank, ok, url, title, published_at, summary.
ADAPTERS = {
    "rss": _feed,
    "hf_papers": lambda rows: listings.papers(rows).select("source_id", "rank", "ok", "url", "title", "published_at", "summary"),
    "hf_blog": _posts("allBlogs"),
    "hf_community": _posts("posts", 20),
}


class NothingUsable(ValueError):
    """A capture without entries, or with malformed ones alone."""


def scan(rows: DataFrame, recipe: str) -> DataFrame:
    """The items in the captures of one recipe; a recipe without an adapter is an error."""
    if recipe not in ADAPTERS:
        raise ValueError(f"no adapter for {recipe}")
    return ADAPTERS[recipe](rows.where(F.col("recipe") == recipe))


def checked_scan(rows: DataFrame, recipe: str) -> DataFrame:
    """scan() of what must hold something: sources whose captures have no usable entry are an error that names some of them."""
    items = scan(rows, recipe)
    used = items.where("ok").select("source_id").distinct()
    bad = [r[0] for r in rows.where(F.col("recipe") == recipe).select("source_id").distinct().join(used, "source_id", "left_anti").orderBy("source_id").limit(5).collect()]
    if bad:
        raise NothingUsable(f"no usable entry: {', '.join(map(str, bad))}")
    return items


class _Range(InputPartition):
    """Bytes of a file: the lines that begin in them."""

    def __init__(self, path: str, start: int, stop: int) -> None:
        super().__init__(path)
        self.path, self.start, self.stop = path, start, stop


#: Bytes of a range; a line longer than that is read by the range in which it begins.
RANGE = 32 << 20
#: A file counts as landed once it is this old: what lands within one tick of the clock is never split.
SETTLED = 0.2
_KEYS = ("recipe", "source_id")


def _files(folder: str) -> list[tuple[str, dict[str, str]]]:
    """Files under a folder with what the folders above them (recipe=..., source_id=...) say of all their lines."""
    out = []
    for at, _, names in os.walk(folder):
        told = dict(p.split("=", 1) for p in os.path.relpath(at, folder).split(os.sep) if "=" in p)
        out += [(os.path.join(at, n), {k: unquote(v) for k, v in told.items() if k in _KEYS}) for n in names if n.endswith(".jsonl")]
    return sorted(out, key=lambda f: f[0])


def _ranges(path: str) -> list[_Range]:
    size = os.path.getsize(path)
    return [_Range(path, i, min(size, i + RANGE)) for i in range(0, size, RANGE)]


def _lines(part: _Range):
    """The lines that begin in a range: the one that reaches into it belongs to the range before."""
    with open(part.path, "rb") as f:
        if part.start:
            f.seek(part.start - 1)
            f.readline()
        while f.tell() < part.stop and (line := f.readline()):
            if line.strip():
                yield line.decode("utf-8", "replace").rstrip("\r\n")


def _captures(part: _Range, wanted: dict[str, set[str]]):
    for line in _lines(part):
        try:
            r = json.loads(line)
            row = (r.get("source_id"), r.get("recipe"), r.get("url"), r.get("body"))
        except (ValueError, AttributeError):
            row = (None, "malformed", part.path, line)
        if all(row[("source_id", "recipe").index(k)] in v for k, v in wanted.items()):
            yield row


class _Reader(DataSourceReader):
    def __init__(self, folder: str, recipe: str | None) -> None:
        self.folder, self.wanted = folder, {}
        if recipe is not None:
            self.wanted["recipe"] = {recipe}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in _KEYS:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f

    def partitions(self):
        some = [path for path, told in _files(self.folder) if all(told.get(k) is None or told[k] in v for k, v in self.wanted.items())]
        return [r for path in some for r in _ranges(path)] or [_Range(os.devnull, 0, 0)]

    def read(self, partition):
        yield from _captures(partition, self.wanted)


class _Landing(DataSourceStreamReader):
    """Files in the order in which they land; an offset is the last one of all. Files are moved in whole, never change and stay, so that a batch read again is the same, and after a restart none comes twice."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _landed(self) -> list[tuple[int, str]]:
        return sorted((os.stat(path).st_ctime_ns, os.path.relpath(path, self.folder)) for path, _ in _files(self.folder))

    def initialOffset(self) -> dict:
        return {"at": 0, "path": ""}

    def latestOffset(self) -> dict:
        young = time.time_ns() - int(SETTLED * 1e9)
        at, path = max((f for f in self._landed() if f[0] < young), default=(0, ""))
        return {"at": at, "path": path}

    def partitions(self, start: dict, end: dict):
        first, last = ((o["at"], o["path"]) for o in (start, end))
        return [r for f in self._landed() if first < f <= last for r in _ranges(os.path.join(self.folder, f[1]))]

    def read(self, partition):
        yield from _captures(partition, {})


class Captured(DataSource):
    """Option path: the folder; option recipe: only captures of one kind. A malformed line is a row of recipe 'malformed', with its file and text.

    Files are read in ranges. Filters on recipe and source_id are applied while reading, and files in folders called recipe=... or
    source_id=... (of which all lines are) are left out by them. As a stream, files count once, in the order in which they land."""

    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("recipe"))

    def streamReader(self, schema):
        return _Landing(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Captured)
