"""State by key that outlives restarts, with timers: sitemap polls and the failure runs of sources.

Both run under transformWithState on RocksDB; states(spark) sets the provider.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST_PAGES, MOST_SEEN = 20, 5000


def states(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Polls(StatefulProcessor):
    """A site's handled addresses; each poll (its entries, in order) gives the pages to fetch and replaces them."""

    def __init__(self, most: int, most_seen: int) -> None:
        self.most, self.most_seen = most, most_seen

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handled = handle.getListState("handled", "url string")
        self.last = handle.getValueState("last", "poll long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        last = self.last.get()[0] if self.last.exists() else -1
        seen = {r[0] for r in self.handled.get()}
        out, kept = [], None
        for poll, listed in every[every["poll"] > last].sort_values(["poll", "pos_no"], kind="stable").groupby("poll"):
            listed = listed.drop_duplicates("url")
            fresh = listed[~listed["url"].isin(seen)].head(self.most)
            retry = set(fresh.loc[fresh["outcome"] == "network", "url"])
            out += [(key[0], poll, u, o) for u, o in zip(fresh["url"], fresh["outcome"], strict=True)]
            kept = [u for u in listed["url"] if u not in retry][: self.most_seen]
            seen, last = set(kept), poll
        if kept is not None:
            self.handled.put([(u,) for u in kept]) if kept else self.handled.clear()
            self.last.update((int(last),))
        yield pd.DataFrame(out, columns=["site", "poll", "url", "outcome"])

    def close(self) -> None:
        pass


def polls(entries: DataFrame, most: int = MOST_PAGES, most_seen: int = MOST_SEEN) -> DataFrame:
    """site, poll, url, outcome of the pages that each poll reads, from a stream of (site, poll, pos_no, url, outcome).

    entries are what a poll lists, newest first, whole in one micro-batch; outcome is what a page's fetch gives or
    would give: 'network' is tried again. A poll that was handled is not handled twice."""
    rows = entries.select("site", "poll", "pos_no", "url", "outcome")
    return rows.groupBy("site").transformWithStateInPandas(Polls(most, most_seen), "site string, poll long, url string, outcome string", "append", "none")


class Runs(StatefulProcessor):
    """A source's failures since its last success; a timer tells when it has been silent for too long."""

    def __init__(self, silence: timedelta) -> None:
        self.silence = int(silence.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "failures long, last_ok timestamp, last_at timestamp")

    def _now(self) -> tuple:
        return self.state.get() if self.state.exists() else (0, None, None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("at", kind="stable")
        failures, last_ok, last_at = self._now()
        good = every[every["ok"]]
        if len(good) and (last_ok is None or good["at"].max() > pd.Timestamp(last_ok)):
            last_ok, failures = good["at"].max(), 0
        failures += int((~every["ok"] & ((every["at"] > pd.Timestamp(last_ok)) if last_ok is not None else True)).sum())
        last_at = every["at"].max() if last_at is None else max(every["at"].max(), pd.Timestamp(last_at))
        plain = lambda t: None if t is None else pd.Timestamp(t).to_pydatetime()
        self.state.update((int(failures), plain(last_ok), plain(last_at)))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(pd.Timestamp(last_at).tz_localize("UTC").timestamp() * 1000) + self.silence)
        yield pd.DataFrame({"source_id": [key[0]], "failures": [int(failures)], "last_ok": pd.to_datetime([last_ok]), "silent": [False]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        failures, last_ok, _ = self._now()
        yield pd.DataFrame({"source_id": [key[0]], "failures": [int(failures)], "last_ok": pd.to_datetime([last_ok]), "silent": [True]})

    def close(self) -> None:
        pass


def failure_runs(log: DataFrame, silence: timedelta = timedelta(days=7), late: str = "1 day") -> DataFrame:
    """source_id, failures, last_ok, silent for each source that a micro-batch touches, from (source_id, ok, at); and once more, silent, when the watermark has passed a source's last entry by `silence`.

    Entries may come out of order within a batch. A success that comes late, older than the last known, changes nothing; failures older than the last success don't count."""
    rows = log.withWatermark("at", late).select("source_id", "ok", "at")
    return rows.groupBy("source_id").transformWithStateInPandas(Runs(silence), "source_id string, failures long, last_ok timestamp, silent boolean", "update", "eventtime")
