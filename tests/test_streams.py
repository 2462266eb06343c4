"""Streams: captures as they land, polls and failure runs by key, days that are still open; each through restarts."""

import json
import os
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftspark.operators import state
from siftspark.sources import readers
from siftspark.streaming import incremental, keyed


def land(folder, name, rows, under=""):
    """Files are moved in whole."""
    os.makedirs(folder / under, exist_ok=True)
    aside = folder / f"{name}.part"
    aside.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.rename(aside, folder / under / f"{name}.jsonl")
    time.sleep(readers.SETTLED + 0.05)


def capture(i, recipe="rss"):
    return {"source_id": f"s{i}", "recipe": recipe, "url": f"u{i}", "body": "b" * (i % 50)}


def test_landing_through_restarts(spark, tmp_path):
    """Two restarts, files that land between them and one that sorts before those read: each entry comes once."""
    readers.register(spark)
    folder, out = tmp_path / "landing", str(tmp_path / "out")
    folder.mkdir()
    for turn, names in enumerate((["m", "n"], ["a", "z"], [], ["b"])):
        for name in names:
            land(folder, name, [capture(i) for i in range(10 * ord(name), 10 * ord(name) + 7)])
        stream = spark.readStream.format("captured").option("path", str(folder)).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        q.processAllAvailable()
        if turn == 0:
            land(folder, "k", [capture(1)])  # while it runs
            deadline = time.time() + 30
            while spark.read.parquet(out).count() < 15 and time.time() < deadline:
                time.sleep(0.2)
        q.stop()
    got = sorted(r.url for r in spark.read.parquet(out).collect())
    assert got == sorted([f"u{i}" for n in "mnazb" for i in range(10 * ord(n), 10 * ord(n) + 7)] + ["u1"])


def test_capture_ranges_and_filters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "RANGE", 300)
    readers.register(spark)
    land(tmp_path, "one", [capture(i) for i in range(60)])
    land(tmp_path, "two", [capture(i, "hf_papers") for i in range(60, 90)], "recipe=hf_papers")
    land(tmp_path, "three", [capture(7)], "recipe=rss/source_id=s7")
    (tmp_path / "one.jsonl").open("a").write("\n \nnot json\n[1]\n")
    load = spark.read.format("captured").load(str(tmp_path))
    every = load.collect()
    assert sorted(r.source_id for r in every if r.source_id) == sorted([f"s{i}" for i in range(90)] + ["s7"]) and sum(r.recipe == "malformed" for r in every) == 2
    parts = lambda df: df.rdd.getNumPartitions()
    sizes = {f: -(-os.path.getsize(tmp_path / f) // 300) for f in ("one.jsonl", "recipe=hf_papers/two.jsonl", "recipe=rss/source_id=s7/three.jsonl")}
    one, two, three = sizes.values()
    assert parts(load) == one + two + three and one > 5
    papers, seven = load.where("recipe = 'hf_papers'"), load.where("source_id IN ('s7', 's70') AND recipe = 'rss'")
    assert parts(papers) == one + two and papers.count() == 30
    assert parts(seven) == one + three and sorted(r.source_id for r in seven.collect()) == ["s7", "s7"]
    assert load.where("recipe = 'rss' AND recipe = 'hf_papers'").count() == 0 and load.where("url = 'u3' AND recipe = 'rss'").count() == 1


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.states(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def feed_stream(spark, tmp_path, schema, name, rows):
    """A stream over a folder of Parquet files, which gets one more with each call."""
    folder = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def drain(stream, tmp_path, name, mode):
    got = []
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start()
    q.awaitTermination()
    return got


def test_polls_stream(spark, tmp_path, rocks):
    schema = "site string, poll long, pos_no int, url string, outcome string"
    batches = [
        [("x", 1, i, f"u{i}", "network" if i == 0 else "ok") for i in range(4)] + [("y", 1, 0, "v", "http")],
        [("x", 2, 0, "new", "ok"), ("x", 2, 1, "u0", "ok"), ("x", 2, 2, "u1", "ok"), ("x", 2, 3, "u3", "ok")],
        [("x", 1, 0, "u9", "ok"), ("x", 3, 0, "u2", "ok"), ("y", 2, 0, "v", "ok"), ("y", 2, 1, "w", "ok")],  # poll 1 comes again
    ]
    got = []
    for rows in batches:  # a restart after each
        stream = keyed.polls(feed_stream(spark, tmp_path, schema, "polls", rows), most=2, most_seen=3)
        got.append(sorted((r.site, r.poll, r.url) for r in drain(stream, tmp_path, "polls", "append")))
    assert got == [[("x", 1, "u0"), ("x", 1, "u1"), ("y", 1, "v")], [("x", 2, "new"), ("x", 2, "u0")], [("x", 3, "u2"), ("y", 2, "w")]]


def test_failure_runs_equal_the_fold(spark, tmp_path, rocks):
    """Through restarts the state is that of the fold over the whole log; a source that stays silent is told of once."""
    schema, start = "source_id string, ok boolean, at timestamp", datetime(2024, 1, 1)
    at = lambda h: start + timedelta(hours=h)
    batches = [
        [("a", True, at(0)), ("a", False, at(2)), ("a", False, at(1)), ("b", False, at(1))],
        [("a", False, at(20)), ("b", True, at(19)), ("c", True, at(3))],
        [("a", True, at(40)), ("b", False, at(41))],
        [("b", False, at(24 * 12))],
        [("b", False, at(24 * 12 + 1))],
    ]
    last, silent, log = {}, [], []
    for rows in batches:
        log += rows
        stream = keyed.failure_runs(feed_stream(spark, tmp_path, schema, "runs", rows), silence=timedelta(days=7))
        for r in drain(stream, tmp_path, "runs", "update"):
            if r.silent:
                silent.append(r.source_id)
            else:
                last[r.source_id] = (r.failures, r.last_ok)
    whole = spark.createDataFrame([(*r, i) for i, r in enumerate(log)], schema + ", n long")
    want = {r.source_id: (r.failures, r.last_ok) for r in state.failures(whole, "source_id", F.col("ok"), "at", "n").collect()}
    assert last == want and sorted(silent) == ["a", "c"]


def test_open_days(spark, tmp_path):
    """Rows of open days replace by key, of closed ones are refused; a batch that comes again changes nothing."""
    path, open_day = str(tmp_path / "table"), [date(2024, 1, 1)]
    write = incremental.day_writer(path, lambda rows: rows.withColumn("day", F.to_date("at")), lambda: open_day[0], ["item"])
    rows = lambda *r: spark.createDataFrame([(i, datetime(2024, 1, d, h), s) for i, d, h, s in r], "item long, at timestamp, score double")
    table = lambda: sorted((r.item, str(r.day), r.score, r.batch) for r in spark.read.parquet(f"{path}/days").collect())
    first = rows((1, 1, 1, 0.1), (2, 1, 1, 0.2), (1, 2, 1, 0.3))
    write(first, 0)
    assert table() == [(1, "2024-01-01", 0.1, 0), (1, "2024-01-02", 0.3, 0), (2, "2024-01-01", 0.2, 0)]
    open_day[0] = date(2024, 1, 2)
    untouched = {f: os.stat(f"{path}/days/day=2024-01-01/{f}").st_mtime_ns for f in os.listdir(f"{path}/days/day=2024-01-01")}
    second = rows((1, 2, 5, 0.9), (1, 1, 9, 9.9), (3, 2, 0, 0.5), (3, 3, 0, 0.6))
    write(second, 1)
    want = [(1, "2024-01-01", 0.1, 0), (1, "2024-01-02", 0.9, 1), (2, "2024-01-01", 0.2, 0), (3, "2024-01-02", 0.5, 1), (3, "2024-01-03", 0.6, 1)]
    assert table() == want
    write(second, 1)  # replayed
    write(rows((1, 2, 4, 0.4)), 2)  # older than what is there
    assert table() == want
    assert untouched == {f: os.stat(f"{path}/days/day=2024-01-01/{f}").st_mtime_ns for f in os.listdir(f"{path}/days/day=2024-01-01")}
    assert [(r.item, r.score) for r in spark.read.parquet(f"{path}/refused").collect()] == [(1, 9.9)]
