"""Scores, states and labels of items as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def recency(age_days: Column) -> Column:
    return F.exp(-F.greatest(F.lit(0.0), age_days) / F.lit(3.0))


def age_hours(age_days: Column) -> Column:
    return F.greatest(F.lit(0), F.bround(age_days * 24).cast("long"))


def combine(terms: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """The weighted mean of the terms that an item has; 0 where their weights come to nothing."""
    have = [F.when(terms[k].isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for k, w in weights.items()]
    parts = [F.coalesce(terms[k], F.lit(0.0)) * F.lit(float(w)) for k, w in weights.items()]
    total, top = sum(have[1:], have[0]), sum(parts[1:], parts[0])
    return F.when(total > 0, top / total).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def reading_minutes(words: Column) -> Column:
    return F.when(words > 0, F.greatest(F.lit(1), F.bround(words / F.lit(230.0)).cast("int")))


def read_state(read_at: Column, progress: Column) -> Column:
    return F.when(read_at.isNull(), "unread").when(F.coalesce(progress, F.lit(0.0)) >= 0.9, "read").otherwise("partial")


def health(failures: Column, last_ok: Column) -> Column:
    return F.when(failures >= 3, "broken").when(failures >= 1, "degraded").when(last_ok.isNotNull(), "ok").otherwise("never")


def is_old(published: Column, first_seen: Column) -> Column:
    return F.coalesce(published.isNotNull() & (first_seen - published > F.expr("INTERVAL 90 DAYS")), F.lit(False))


def humanize_age(minutes: Column) -> Column:
    """A short age: minutes, hours, days, weeks, months."""
    def n(size: int, mark: str) -> Column:
        return F.concat(F.floor(minutes / size).cast("string"), F.lit(mark))

    return F.when(minutes < 60, n(1, "m")).when(minutes < 1440, n(60, "h")).when(minutes < 7 * 1440, n(1440, "d")).when(minutes < 30 * 1440, n(7 * 1440, "w")).otherwise(n(30 * 1440, "mo"))


def compact(n: Column) -> Column:
    """A count as 999, 1.2k or 3.4M."""
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.concat((F.floor(n / 100) / 10).cast("string"), F.lit("k"))).otherwise(F.concat((F.floor(n / 100_000) / 10).cast("string"), F.lit("M")))


def signal_notes(upvotes: Column, upvotes7d: Column, stars: Column, comments: Column) -> Column:
    up = F.when(upvotes.isNotNull(), F.concat(upvotes.cast("string"), F.lit(" upvotes"))).when(upvotes7d.isNotNull(), F.concat(upvotes7d.cast("string"), F.lit(" upvotes this week")))
    return F.concat_ws(" · ", up, F.when(stars > 0, F.concat(stars.cast("string"), F.lit(" stars"))), F.when(comments > 0, F.concat(comments.cast("string"), F.lit(" comments"))))


def price(tokens_in: Column, tokens_out: Column, per_in: Column, per_out: Column) -> Column:
    return (tokens_in * per_in + tokens_out * per_out) / F.lit(1e6)


def shown(x: Column) -> Column:
    """A term of a breakdown as it is kept: four places, halves to even."""
    return F.bround(x, 4)


def ago(seconds: Column) -> Column:
    """How long ago, in the largest unit that fits: just now, 5m, 3h, 2d, 4w."""
    steps = ((604800, "w"), (86400, "d"), (3600, "h"), (60, "m"))
    out = F.lit("just now")
    for size, unit in reversed(steps):
        out = F.when(seconds >= size, F.concat(F.floor(seconds / size).cast("string"), F.lit(unit))).otherwise(out)
    return out
