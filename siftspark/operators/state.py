"""State: merges of a batch into a table, folds of an event log, constraints.

Each merge takes the table as it is and the batch, and returns the next table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import canonical_url, content_hash, item_id, paper_id
from ..functions.clock import local_day
from ..functions.score import is_old
from ..functions.text import one_line, strip_controls
from .storage import checkpoint


SUMMARY = 1000
SIGNALS = ("rank", "upvotes", "upvotes7d", "github_stars", "comments")


def normalize(raw: DataFrame) -> DataFrame:
    """Captured entries (pos, source_id, kind, title, url, authors, published_at, summary, paper_id, image_url and signals) as items, with ok: entries without a title aren't, and are left out by store()."""
    clean = lambda c: one_line(strip_controls(c))
    summary = F.substring(F.trim(strip_controls(F.coalesce("summary", F.lit("")))), 1, SUMMARY)
    paper = F.coalesce("paper_id", paper_id(F.col("url"), F.col("summary")))
    out = raw.withColumns({"title": F.coalesce(clean(F.col("title")), F.lit("")), "summary": summary, "url": F.trim("url"), "authors": F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), clean), lambda x: x != "")})
    out = out.withColumn("paper_id", paper).withColumn("canonical_url", canonical_url(F.col("url")))
    return out.withColumn("id", item_id(F.col("kind"), F.col("url"), F.col("paper_id"), F.col("canonical_url"))).withColumn("ok", F.col("title") != "")


_KEPT = ("source_id", "kind", "url", "canonical_url")


def store(table: DataFrame, batch: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """Items after a normalized batch, and created (whether the batch brought them); batch rows count in the order of pos.

    A row is the item with its id, else the one with its canonical address. Of a batch's new rows those of one id are
    one item, and an id whose first row has the address of an earlier id's first row is that item. Then, for an item:
    title, the last; summary, the last that isn't empty; date and paper, the first there is; authors, the first that
    aren't empty; image, the last there is; source, kind and addresses stay; seen again once a local day."""
    new = checkpoint(batch.where("ok"))  # read from three sides
    ids, urls = table.select("id").withColumn("hit", F.col("id")), table.groupBy("canonical_url").agg(F.min("id").alias("by_url"))
    lead = new.groupBy("id").agg(F.min_by("canonical_url", "pos").alias("canonical_url"), F.min("pos").alias("first_pos"))
    same = lead.groupBy("canonical_url").agg(F.min_by("id", "first_pos").alias("lead_id"))
    known = new.join(ids, "id", "left").join(urls, "canonical_url", "left").join(lead.select("id", F.col("canonical_url").alias("lead_url")), "id").join(same.withColumnRenamed("canonical_url", "lead_url"), "lead_url")
    target = known.withColumn("target", F.coalesce("hit", "by_url", "lead_id"))
    there = lambda c: F.when(F.col(c).isNotNull(), F.col("pos"))
    full = lambda c: F.when(F.col(c) != "", F.col("pos"))
    merged = target.groupBy("target").agg(
        F.max_by("title", "pos").alias("n_title"), F.max_by("summary", full("summary")).alias("n_summary"), F.min_by("published_at", there("published_at")).alias("n_published"), F.min_by("paper_id", there("paper_id")).alias("n_paper"),
        F.min_by("authors", F.when(F.size("authors") > 0, F.col("pos"))).alias("n_authors"), F.max_by("image_url", there("image_url")).alias("n_image"), *[F.min_by(c, "pos").alias(f"n_{c}") for c in _KEPT])
    out = table.join(merged, table["id"] == F.col("target"), "full")
    met, fresh = F.col("target").isNotNull(), F.col("id").isNull()
    summary, published, first = F.coalesce("n_summary", "summary", F.lit("")), F.coalesce("published_at", "n_published"), F.coalesce("first_seen", now)
    again = met & ~fresh & (local_day(F.col("last_seen"), zone) != local_day(now, zone))
    title = F.coalesce("n_title", "title")
    none = F.array().cast("array<string>")
    return out.select(
        F.coalesce("id", "target").alias("id"), *[F.coalesce(c, f"n_{c}").alias(c) for c in _KEPT], title.alias("title"), F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.coalesce("n_authors", "authors", none)).alias("authors"),
        published.alias("published_at"), summary.alias("summary"), F.coalesce("paper_id", "n_paper").alias("paper_id"), F.coalesce("n_image", "image_url").alias("image_url"), first.alias("first_seen"), F.when(met, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(fresh, F.lit(1)).otherwise(F.col("times_seen") + again.cast("int")).cast("long").alias("times_seen"), F.when(met, content_hash(title, summary)).otherwise(F.col("content_hash")).alias("content_hash"), is_old(published, first).alias("is_old"), fresh.alias("created"))


def store_statistics(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """seen (entries taken), skipped (entries without a title) and new (items that the batch created)."""
    return batch.agg(F.count_if("ok").alias("seen"), F.count_if(~F.col("ok")).alias("skipped")).crossJoin(stored.agg(F.count_if("created").alias("new")))  # one row each


def record_signals(table: DataFrame, batch: DataFrame) -> DataFrame:
    """Signals (item_id, observed_on, ...) after a batch, whose pos orders it: the last row of an item and day stays; rows without any value are skipped."""
    some = batch.where(F.coalesce(*[F.col(c).cast("double") for c in SIGNALS]).isNotNull())
    both = table.withColumn("pos", F.lit(-1).cast("long")).unionByName(some.select(*table.columns, F.col("pos").cast("long").alias("pos")))
    return both.groupBy("item_id", "observed_on").agg(F.max_by(F.struct(*SIGNALS), "pos").alias("_r")).select("item_id", "observed_on", "_r.*")


def enrich(items: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Items after their pages were read: found (item_id, summary) has a row for each try. A try is recorded even if nothing came of it; an empty summary changes nothing."""
    f = found.groupBy(F.col("item_id").alias("_id")).agg(F.max(F.coalesce("summary", F.lit(""))).alias("_new"))
    out = items.join(f, items["id"] == F.col("_id"), "left")
    tried = F.col("_id").isNotNull()
    summary = F.coalesce(F.nullif("_new", F.lit("")), "summary")
    return out.withColumn("enriched_at", F.when(tried, now).otherwise(F.col("enriched_at"))).withColumn("content_hash", F.when(tried, content_hash(F.col("title"), summary)).otherwise(F.col("content_hash"))).withColumn("summary", F.when(tried, summary).otherwise(F.col("summary"))).drop("_id", "_new")


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table and those of the rows whose key it lacks: seeds, appended history."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def change_sources(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """Sources after changes (id, action, value), at most one for each: enable, disable, remove (built-in ones stay) and replace (of the recipe; health and what was fetched start anew)."""
    c = changes.select(F.col("id").alias("_id"), "action", "value")
    out = sources.join(c, sources["id"] == F.col("_id"), "left").where(~F.coalesce((F.col("action") == "remove") & (F.col("origin") != "builtin"), F.lit(False)))
    anew = F.coalesce(F.col("action") == "replace", F.lit(False))
    enabled = F.when(F.col("action") == "enable", True).when(F.col("action") == "disable", False).otherwise(F.col("enabled"))
    return out.withColumns({"enabled": enabled, "recipe": F.when(anew, F.col("value")).otherwise(F.col("recipe")), "failures": F.when(anew, 0).otherwise(F.col("failures")), "last_ok": F.when(~anew, F.col("last_ok")), "fetch_state": F.when(~anew, F.col("fetch_state"))}).drop("_id", "action", "value")


def runs_of(log: DataFrame, now: Column) -> DataFrame:
    """Runs from their log (run_id, event, at, status, tokens_in, tokens_out, cost): started, finished, status, usage summed. A run that didn't finish and isn't going on was interrupted; log has the event 'alive' for those that are."""
    by = log.groupBy("run_id").agg(
        F.min(F.when(F.col("event") == "start", F.col("at"))).alias("started_at"), F.max(F.when(F.col("event") == "finish", F.col("at"))).alias("finished_at"), F.max_by("status", F.when(F.col("event") == "finish", F.col("at"))).alias("status"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out", "cost")], F.max(F.col("event") == "alive").alias("alive"))
    status = F.when(F.col("finished_at").isNotNull(), F.col("status")).when(F.col("alive"), "running").otherwise("interrupted")
    return by.select("run_id", "started_at", F.when(status == "interrupted", now).otherwise(F.col("finished_at")).alias("finished_at"), status.alias("status"), "tokens_in", "tokens_out", "cost")


def finish_discoveries(discoveries: DataFrame, ended: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Discovery runs (id, query, status, finished_at, tokens_in, tokens_out, chosen) after some ended (id, status, chosen); tokens are those of the run of the same id, 0 without one."""
    e = ended.select(F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("chosen").alias("_chosen"))
    u = runs.select(F.col("run_id").alias("_run"), F.col("tokens_in").alias("_in"), F.col("tokens_out").alias("_out"))
    out = discoveries.join(e, discoveries["id"] == F.col("_id"), "left").join(u, discoveries["id"] == F.col("_run"), "left")
    done = F.col("_id").isNotNull()
    used = lambda c, d: F.when(done, F.coalesce(c, F.lit(0))).otherwise(F.col(d)).alias(d)
    return out.select("id", "query", F.when(done, F.col("_status")).otherwise(F.col("status")).alias("status"), F.when(done, now).otherwise(F.col("finished_at")).alias("finished_at"), used("_in", "tokens_in"), used("_out", "tokens_out"), F.when(done, F.col("_chosen")).otherwise(F.col("chosen")).alias("chosen"))


def check_version(applied: Sequence[int], known: Sequence[int]) -> list[int]:
    """The versions still to be applied; versions must be 1, 2, 3, ... and none applied may be newer than those known."""
    if sorted(known) != list(range(1, len(known) + 1)):
        raise ValueError("versions must be numbered without gaps")
    if applied and max(applied) > len(known):
        raise ValueError(f"the data is of version {max(applied)}, newer than {len(known)}")
    return [n for n in sorted(known) if n > max(applied, default=0)]


def upsert_items(table: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Items after a batch: key, title, summary, published_at, first_seen, last_seen, times_seen, is_old.

    Titles are replaced; summaries unless the new one is empty; dates fill once; an item counts as seen again once a day."""
    b = batch.select("key", *[F.col(c).alias(f"n_{c}") for c in ("title", "summary", "published_at")])
    out = table.join(b, "key", "full")
    fresh, met = F.col("first_seen").isNull(), F.col("n_title").isNotNull()
    published = F.coalesce("published_at", "n_published_at")
    first = F.coalesce("first_seen", now)
    again = met & ~fresh & (F.to_date("last_seen") < F.to_date(now))
    return out.select(
        "key", F.coalesce("n_title", "title").alias("title"), F.coalesce(F.nullif("n_summary", F.lit("")), "summary", "n_summary").alias("summary"), published.alias("published_at"), first.alias("first_seen"),
        F.when(met, now).otherwise(F.col("last_seen")).alias("last_seen"), (F.when(fresh, 1).otherwise(F.col("times_seen") + again.cast("int"))).cast("long").alias("times_seen"), is_old(published, first).alias("is_old"))


def upsert_last(table: DataFrame, batch: DataFrame, keys: Sequence[str], when: str) -> DataFrame:
    """Rows by key, the latest of table and batch."""
    both = table.unionByName(batch)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), when).alias("_r")).select(*keys, "_r.*")


def toggles(log: DataFrame, key: str, actions: Sequence[str]) -> DataFrame:
    """Flags after all toggles, from off: on after an odd number."""
    return log.groupBy(key).agg(*[(F.count_if(F.col("action") == a) % 2 == 1).alias(a) for a in actions])


def progress(log: DataFrame, key: str, value: Column) -> DataFrame:
    return log.groupBy(key).agg(F.max(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))).alias("read_progress"))


def failures(log: DataFrame, key: str, ok: Column, at: str, tie: str) -> DataFrame:
    """key, failures since the last success, last_ok: two aggregations, no window over a key."""
    good = log.where(ok).groupBy(key).agg(F.max(F.struct(at, tie)).alias("_ok"))
    both = log.where(~ok).join(good, key, "full")
    later = F.col(at).isNotNull() & (F.col("_ok").isNull() | (F.struct(at, tie) > F.col("_ok")))
    return both.groupBy(key).agg(F.count_if(later).alias("failures"), F.max(F.col(f"_ok.{at}")).alias("last_ok"))


def budget(usage: DataFrame, cap: float) -> DataFrame:
    """Whether each call was allowed: the day's spending before it is under the cap.

    An hour's sums come first, so a task holds the calls of an hour, or the 24 sums of a day."""
    hour = F.hour("ts").alias("_hour")
    rows = usage.select("*", hour)
    sums = rows.groupBy("day", "_hour").agg(F.sum("cost_usd").alias("_s"))
    earlier = sums.select("day", "_hour", F.coalesce(F.sum("_s").over(Window.partitionBy("day").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    within = F.sum("cost_usd").over(Window.partitionBy("day", "_hour").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_within", F.coalesce(within, F.lit(0))).join(earlier, ["day", "_hour"]).withColumn("allowed", F.col("_earlier") + F.col("_within") < cap).drop("_hour", "_within", "_earlier")


def survivors(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is left: a cascade is a chain of these."""
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


@dataclass(frozen=True)
class Reference:
    """A row of table refers by key to a row of parent, and goes with it."""

    table: str
    key: str
    parent: str
    parent_key: str


def cascade(tables: dict[str, DataFrame], references: Sequence[Reference], deleted: dict[str, tuple[str, DataFrame]]) -> dict[str, DataFrame]:
    """Every table after deletions; deleted has, for some tables, a key column and the keys to go.

    Tables are walked from parents to children. What passes down is the keys of rows that go, so a level costs a
    semi-join of its rows with these, and a table that nothing reaches comes back as it is. Null keys refer to nothing."""
    gone: dict[str, list[DataFrame]] = {}  # rows of a table that go, by reason
    out: dict[str, DataFrame] = {}
    for name in _parents_first(list(tables), references):
        rows = tables[name]
        reasons = [(key, keys.select(F.col(keys.columns[0]).alias(key))) for key, keys in [deleted[name]]] if name in deleted else []
        for r in references:
            if r.table == name and r.parent in gone:
                lost = None
                for g in gone[r.parent]:
                    part = g.select(F.col(r.parent_key).alias(r.key))
                    lost = part if lost is None else lost.unionByName(part)
                reasons.append((r.key, lost))
        left = rows
        for key, keys in reasons:
            some = keys.where(F.col(key).isNotNull()).distinct()
            if any(r.parent == name for r in references):
                gone.setdefault(name, []).append(rows.join(some, key, "left_semi"))
            left = left.join(some, key, "left_anti")
        out[name] = left
    return out


def _parents_first(names: Sequence[str], references: Sequence[Reference]) -> list[str]:
    """Names with every parent before its children; a table may refer to itself no more than to a ring of others."""
    left, out = list(names), []
    while left:
        free = [n for n in left if not any(r.table == n and r.parent in left for r in references)]
        if not free:
            raise ValueError(f"references in a ring: {', '.join(left)}")
        out += free
        left = [n for n in left if n not in free]
    return out


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules])))
