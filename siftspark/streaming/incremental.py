"""Items and interactions as streams.

New captures are deduplicated within a watermark and merged by day; interactions
are folded per item with state that survives restarts; activity is counted in
windows. Sinks write by micro-batch, so that a replayed batch has no other effect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 day"


def fresh_items(stream: DataFrame, key: str = "id", at: str = "at", late: str = LATE) -> DataFrame:
    """The first row of each key; copies within the watermark are dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, at: str = "at", late: str = LATE) -> DataFrame:
    """Events by calendar day and action."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), "action").count().select(F.to_date("w.start").alias("day"), "action", "count")


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """key, start, stop, n of runs of events no more than a gap apart; works on batches and, with a watermark, on streams."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


_STATE = "liked boolean, saved boolean, hidden boolean, opens long, read_progress double"
_FLAG = {"like": 0, "save": 1, "hide": 2}


def _fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = list(state.get) if state.exists else [False, False, False, 0, 0.0]
    for b in batches:
        counts = b["action"].value_counts()
        for action, at in _FLAG.items():
            now[at] = bool(now[at]) ^ bool(counts.get(action, 0) % 2)
        opened = b[b["action"] == "open"]
        now[3] = int(now[3]) + len(opened)
        if len(opened):
            now[4] = max(float(now[4]), float(opened["value"].clip(0, 1).max()))
    state.update(tuple(now))
    yield pd.DataFrame([[key[0], *now]], columns=["item_id", "liked", "saved", "hidden", "opens", "read_progress"])


def item_states(stream: DataFrame) -> DataFrame:
    """The state of every item that a micro-batch touches, from (item_id, action, value): toggles by parity, progress as a maximum."""
    return stream.groupBy("item_id").applyInPandasWithState(_fold, f"item_id long, {_STATE}", _STATE, "update", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, name: str, checkpoint: str, merge: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Start a query that hands each micro-batch to merge(rows, batch id), once for what is there now."""
    return stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def day_writer(path: str, day_of: Callable[[DataFrame], DataFrame], open_from: Callable[[], Any], keys: list[str], at: str = "at") -> Callable[[DataFrame, int], None]:
    """What run() hands micro-batches to, to keep a table by day under path: rows (with day) of days that are still open are merged, the last by `at` of each of keys; closed days are refused.

    open_from() gives the first open day. Only the days of a batch are read and rewritten. Each row keeps the batch
    that brought it, so a batch that is replayed after a crash finds its own rows and changes nothing. Refused rows
    are kept under path/refused, by batch."""
    from ..operators.storage import checkpoint

    def merge(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        dated = checkpoint(day_of(rows))
        first = F.lit(open_from()).cast("date")
        late = dated.where(F.col("day") < first)
        late.write.mode("overwrite").parquet(f"{path}/refused/batch={batch}")
        fresh = dated.where(F.col("day") >= first).withColumn("batch", F.lit(batch).cast("long"))
        days = [r.day for r in fresh.select("day").distinct().collect()]  # the days of one batch that are open
        if not days:
            return
        whole = fresh
        try:
            stored = spark.read.schema(fresh.schema).parquet(f"{path}/days").where(F.col("day").isin(days))
            whole = stored.unionByName(fresh)
        except AnalysisException:
            pass
        rest = [c for c in fresh.columns if c not in (*keys, "day")]
        # Of equal moments the earlier batch stays, so that a batch that comes again is no news.
        best = whole.groupBy("day", *keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), -F.col("batch"))).alias("_r")).select("day", *keys, "_r.*")
        checkpoint(best).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/days")

    return merge
