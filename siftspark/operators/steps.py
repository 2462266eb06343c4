"""Steps around model calls and runs: batches and payloads, repair, acceptance, due work, statistics.

A call is whatever function the caller brings; nothing here knows a provider.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import slug
from ..functions.fences import fenced
from ..functions.text import clip, word_count
from .guard import checked
from .lists import HIDING
from .order import number_rows

BATCH, SUMMARY, RETRY = 50, 600, "INTERVAL 1 HOUR"
MOST_RECIPES = 5
# Where a recipe holds its address.
RECIPE_KEYS = ("url", "feed_url", "sitemap_url")


def shuffled_batches(items: DataFrame, seed: int, size: int = BATCH) -> DataFrame:
    """items with batch and idx, in an order that depends on the seed alone."""
    mixed = items.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))))
    at = F.col("position") - 1
    return number_rows(mixed, F.asc("_h"), F.asc("id")).select(*items.columns, F.floor(at / size).cast("long").alias("batch"), (at % size).cast("long").alias("idx"))


def payloads(batches: DataFrame) -> DataFrame:
    """batch, payload: what a model is shown of a batch, as JSON; `size` entries at most."""
    entry = F.struct("idx", clip(F.col("title"), 200).alias("title"), clip(F.col("summary"), SUMMARY).alias("summary"))
    return batches.groupBy("batch").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("payload"))


def settle(batch: Sequence[Any], call: Callable[[Sequence[Any], str | None], Any], accept: Callable[[Sequence[Any], Any], list]) -> tuple[list, list]:
    """(accepted, failed): a reply that isn't accepted is repaired once; then the batch is halved, down to single entries."""
    todo, done, failed = [list(batch)], [], []
    while todo:
        part = todo.pop(0)
        problem: str | None = None
        for _ in range(2):
            try:
                done += accept(part, call(part, problem))
                break
            except ValueError as e:
                problem = str(e)
        else:
            half = len(part) // 2
            if half:
                todo[:0] = [part[:half], part[half:]]
            else:
                failed += part
    return done, failed


def triage_statistics(items: DataFrame, triage: DataFrame) -> DataFrame:
    both = items.select("id").join(triage.select(F.col("item_id").alias("id"), "relevance", "flags"), "id", "left")
    hidden = F.exists("flags", lambda f: f.isin(*HIDING))
    return both.agg(F.count("*").alias("attempted"), F.count_if(F.col("relevance").isNotNull()).alias("triaged"), F.count_if(F.col("relevance").isNull()).alias("failed"), F.count_if(F.coalesce(hidden, F.lit(False))).alias("hidden"))


def digest_statistics(digests: DataFrame, triage: DataFrame) -> DataFrame:
    """By day: items, hidden, without_relevance."""
    both = digests.join(triage.select("item_id", "relevance", "flags"), "item_id", "left")
    hidden = F.coalesce(F.exists("flags", lambda f: f.isin(*HIDING)), F.lit(False))
    return both.groupBy("day").agg(F.count("*").alias("items"), F.count_if(hidden).alias("hidden"), F.count_if(F.col("relevance").isNull()).alias("without_relevance"))


def last_runs(runs: DataFrame, statuses: Sequence[str] = ()) -> DataFrame:
    """The newest run of each kind, of some statuses if given."""
    some = runs.where(F.col("status").isin(*statuses)) if statuses else runs
    rest = [c for c in runs.columns if c != "kind"]
    return some.groupBy("kind").agg(F.max_by(F.struct(*rest), F.struct("started_at", "id")).alias("r")).select("kind", "r.*")


def extraction_due(items: DataFrame, contents: DataFrame, now: Column, version: int) -> DataFrame:
    """Items whose text has to be fetched: never tried, read by another extractor, or without a text (failed, or behind a paywall) for more than an hour."""
    c = contents.select(F.col("item_id").alias("id"), "status", "extractor_version", "fetched_at")
    both = items.select("id").join(c, "id", "left")
    why = F.when(F.col("status").isNull(), "new").when((F.col("status") == "ok") & (F.col("extractor_version") != version), "old").when((F.col("status") != "ok") & (F.col("fetched_at") <= now - F.expr(RETRY)), "retry")
    return both.select("id", why.alias("reason")).where("reason IS NOT NULL")


# Answers that ask for money or a login.
PAYWALLED = (401, 402, 403)


def store_contents(contents: DataFrame, tried: DataFrame, now: Column, version: int) -> DataFrame:
    """Contents (item_id, status, body, extractor, words, error, extractor_version, fetched_at) after some texts were fetched: tried has item_id, at, http (the answer's status), body, extractor, error.

    The last try of an item replaces what there was, whatever came of it: 'ok' with a text, 'paywalled' where the answer
    asks for money or a login, else 'failed'. The rest stays."""
    last = tried.groupBy("item_id").agg(F.max_by(F.struct("http", "body", "extractor", "error"), "at").alias("_t"))
    ok = F.col("_t.body").isNotNull() & F.coalesce(F.col("_t.http") < 400, F.lit(True))
    status = F.when(ok, "ok").when(F.col("_t.http").isin(*PAYWALLED), "paywalled").otherwise("failed")
    error = F.when(~ok, F.coalesce("_t.error", F.concat(F.lit("HTTP "), F.col("_t.http").cast("string")), F.lit("no text")))
    fresh = last.select("item_id", status.alias("status"), F.when(ok, F.col("_t.body")).alias("body"), F.when(ok, F.col("_t.extractor")).otherwise(F.lit("none")).alias("extractor"), F.when(ok, word_count(F.col("_t.body"))).cast("long").alias("words"), error.alias("error"), F.lit(version).alias("extractor_version"), now.alias("fetched_at"))
    return contents.join(fresh.select("item_id"), "item_id", "left_anti").unionByName(fresh.select(*contents.columns))


def last_run_of_day(runs: DataFrame, kind: str, start: Column, end: Column, statuses: Sequence[str] = ("ok", "partial")) -> DataFrame:
    """The newest run of a kind that began within a day (its bounds are clock.day_bounds') and came to something; one row, or none."""
    some = runs.where((F.col("kind") == kind) & F.col("status").isin(*statuses) & (F.col("started_at") >= start) & (F.col("started_at") < end))
    return some.orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def save_ask(asks: DataFrame, asked: DataFrame) -> DataFrame:
    """Saved questions (id, run_id, scope, question, answer, citations, model, created_at) and new ones, whose ids go on from the last in the order of pos."""
    last = asks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    new = number_rows(asked, F.asc("created_at"), F.asc("pos"), name="_n").crossJoin(F.broadcast(last))  # one row
    return asks.unionByName(new.withColumn("id", F.col("_last") + F.col("_n")).select(*asks.columns))


def recent_asks(asks: DataFrame, limit: int = 20) -> DataFrame:
    return asks.orderBy(F.desc("id")).limit(limit)


def content_due(contents: DataFrame, stored: DataFrame, vectors: bool) -> DataFrame:
    """Readable contents that the index lacks, has under another hash, or (if vectors are possible) without a vector."""
    rows = contents.where("status = 'ok' AND trim(body) <> ''").join(stored.select("item_id", "hash", "has_vector"), "item_id", "left")
    new = ~F.sha1("body").eqNullSafe(F.col("hash"))
    return rows.where(new | (F.lit(vectors) & ~F.coalesce("has_vector", F.lit(False)))).select("item_id", F.when(F.col("hash").isNull(), "missing").when(new, "changed").otherwise("no vector").alias("reason"))


def accepted_recipes(proposed: DataFrame, tested: DataFrame, existing: DataFrame, most: int = MOST_RECIPES) -> DataFrame:
    """Proposed recipes that were tested, each once, the first few, marked where a source has them already."""
    ok = proposed.join(tested.select("hash"), "hash", "left_semi").groupBy("run", "hash").agg(F.min("pos").alias("pos"))
    kept = ok.groupBy("run").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "hash"))), 1, most).alias("r")).select("run", F.inline("r"))
    return kept.join(existing.select("hash", F.lit(True).alias("known")), "hash", "left").select("run", "pos", "hash", F.coalesce("known", F.lit(False)).alias("duplicate"))


def confirmed(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """name, url, id of candidates whose address no source has, with ids that no source and no earlier candidate has."""
    from pyspark.sql import Window

    new = candidates.groupBy("url").agg(F.min("name").alias("name")).join(sources.select("url"), "url", "left_anti").withColumn("base", slug(F.col("name"), 60))
    taken = sources.select(F.regexp_replace("id", r"-\d+$", "").alias("base")).groupBy("base").agg(F.count("*").alias("taken"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("url")) + F.coalesce("taken", F.lit(0))
    return new.join(taken, "base", "left").select("name", "url", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string"))).alias("id"))


def breakdown_line(mode: Column, terms: dict[str, Column]) -> Column:
    """What a score is made of, in one line."""
    shown = [F.when(v.isNotNull(), F.concat(F.lit(f"{k} "), F.format_number(v, 2))) for k, v in terms.items()]
    return F.concat_ws(" · ", mode, *shown)


def health_note(health: Column, failures: Column) -> Column:
    return F.when(health == "broken", F.concat(F.lit("broken: "), failures.cast("string"), F.lit(" failures in a row"))).when(health == "degraded", F.lit("the last fetch failed")).when(health == "never", F.lit("not fetched yet"))


def transcript(events: DataFrame, most: int = 200) -> DataFrame:
    """session, n, line of events with parts (kind, name, text), each on one line of at most `most` characters."""
    parts = events.select("session", "pos", F.posexplode("parts").alias("at", "p"))
    said = F.when(F.col("p.kind") == "call", F.concat(F.lit("> "), "p.name", F.lit(" "), "p.text")).when(F.col("p.kind") == "reply", F.concat(F.lit("< "), "p.name", F.lit(" "), "p.text")).otherwise(F.col("p.text"))
    return parts.select("session", "pos", "at", clip(said, most).alias("line"))


def find_by_recipe_url(sources: DataFrame, recipe: Column, url: str) -> DataFrame:
    """id of the first source whose recipe has the address, under any of the keys that recipes use."""
    hit = F.lit(False)
    for key in RECIPE_KEYS:
        hit |= F.coalesce(F.get_json_object(recipe, f"$.{key}") == url, F.lit(False))
    return sources.where(hit).agg(F.min("id").alias("id")).where("id IS NOT NULL")


def can_rediscover(origin: Column) -> Column:
    return origin == "user"


def rediscover_target(homepage: Column, recipe_url: Column, name: Column) -> Column:
    """Where to look for a source anew: its homepage, else the site of its recipe, else its name."""
    site = F.nullif(F.regexp_extract(recipe_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.lit(""))
    return F.coalesce(F.nullif(homepage, F.lit("")), F.concat(site, F.lit("/")), name)


def cached_summaries(summaries: DataFrame, wanted: DataFrame, version: str, model: str) -> DataFrame:
    """Summaries of wanted items (item_id) by just this version of the prompt and model."""
    return summaries.where((F.col("prompt_version") == version) & (F.col("model") == model)).join(wanted.select("item_id"), "item_id", "left_semi")


def names_of(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the name of their key, or the key itself where it has none."""
    return rows.join(names.select(F.col("id").alias(key), F.col("name").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.col(key).cast("string")))


def count_new(items: DataFrame, state: DataFrame, since: Column | None) -> DataFrame:
    """n: items first seen after a visit that are neither opened nor hidden; 0 without a visit."""
    if since is None:
        return items.agg(F.lit(0).cast("long").alias("n"))
    s = state.select(F.col("item_id").alias("id"), "read_at", "hidden")
    return items.where(F.col("first_seen") > since).join(s, "id", "left").agg(F.count_if(F.col("read_at").isNull() & ~F.coalesce("hidden", F.lit(False))).alias("n"))


def recipe_test(items: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """By recipe (run): how many items it found, why it is refused (null if it isn't), and the first samples. Only where all items are dated can the newest be too old."""
    from pyspark.sql import Window

    first = items.withColumn("_n", F.row_number().over(Window.partitionBy("run").orderBy("rank")))
    by = first.groupBy("run").agg(F.count("title").alias("found"), F.count("published_at").alias("dated"), F.max("published_at").alias("newest"), F.array_sort(F.collect_list(F.when((F.col("_n") <= most) & F.col("title").isNotNull(), F.struct("_n", "title")))).alias("s"))
    stale = (F.col("dated") == F.col("found")) & (F.col("newest") < now - F.expr("INTERVAL 365 DAYS"))
    why = F.when(F.col("found") == 0, "it found no items").when(stale, F.concat(F.lit("its newest item is of "), F.date_format("newest", "yyyy-MM-dd")))
    return by.select("run", "found", why.alias("refused"), F.transform("s", lambda x: x["title"]).alias("samples"))


@dataclass(frozen=True)
class Answer:
    text: str
    passages: list[dict]
    cited: list[int]
    removed: list[str]
    refused: str | None = None


def ask(question: str, search: Callable[[str], DataFrame], passages: DataFrame, model: Callable[[str], str], ensure: Callable[[], None] = lambda: None, problem: Callable[[], str | None] = lambda: None, k: int = 8) -> Answer:
    """An answer with checked citations from the k best passages (chunk_id, header, text) of a search; refused where the caller names a problem or nothing is found.

    Only the passages shown come to the driver, k of them."""
    if (why := problem()) is not None:
        return Answer("", [], [], [], why)
    ensure()
    hits = search(question).where(F.col("rank") <= k).join(passages, "chunk_id").orderBy("rank").select("chunk_id", "rank", "header", "text").limit(k).collect()
    if not hits:
        return Answer("", [], [], [], "nothing was found")
    shown = [{"n": n, **r.asDict()} for n, r in enumerate(hits, 1)]
    numbered = "\n\n".join(f"[{p['n']}] {p['header']}\n{p['text']}" for p in shown)
    text, cited, removed = checked(model(fenced([("Question:\n", False), (question, True), ("\n\nPassages:\n", False), (numbered, True)])), len(shown))
    return Answer(text, shown, cited, removed)


def prefetch(ids: Sequence[Any], steps: Sequence[Callable[[Any], bool]], problem: Callable[[], str | None]) -> tuple[list[Any], list[Any], str | None]:
    """(done, failed, why it stopped): the steps of each id in order, until one says no; before each id the budget is asked."""
    done: list[Any] = []
    failed: list[Any] = []
    for i in ids:
        if (why := problem()) is not None:
            return done, failed, why
        (done if all(step(i) for step in steps) else failed).append(i)
    return done, failed, None
