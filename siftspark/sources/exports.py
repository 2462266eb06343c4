"""Sinks: the daily Markdown export and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import inert_markdown, inert_url


def daily_lines(shown: DataFrame) -> DataFrame:
    """day, body: one Markdown document for each day, from rows (day, position, title, url, source, kind, score, why_read, tags, hidden, flags).

    Entries in digest order, then the items hidden by triage. A day's digest is a page of a few hundred rows, which is what a task gathers."""
    title, url = inert_markdown(F.col("title")), inert_url(F.col("url"))
    head = F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), title, F.lit("\n\n"))
    why = F.when(F.coalesce("why_read", F.lit("")) != "", F.concat(F.lit("**Why read:** "), inert_markdown(F.col("why_read")), F.lit("\n\n"))).otherwise(F.lit(""))
    meta = F.concat(F.lit("- "), F.concat_ws(" · ", inert_markdown(F.col("source")), F.col("kind"), F.format_string("score %.1f", F.col("score") * 10)), F.lit("\n"))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("- Tags: "), F.array_join(F.transform("tags", inert_markdown), ", "), F.lit("\n"))).otherwise(F.lit(""))
    link = F.when(url.isNotNull(), F.concat(F.lit("- Links: [Open]("), url, F.lit(")\n"))).otherwise(F.lit(""))
    from pyspark.sql import Window

    w = Window.partitionBy("day", "hidden").orderBy("position")
    rows = shown.withColumn("n", F.row_number().over(w))
    entry = F.when(~F.col("hidden"), F.concat(head, why, meta, tags, link)).otherwise(F.concat(F.lit("- "), title, F.lit(" ("), F.array_join(F.array_sort("flags"), ", "), F.lit(")"), F.when(url.isNotNull(), F.concat(F.lit(" · [Open]("), url, F.lit(")"))).otherwise(F.lit(""))))
    by = rows.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("hidden", "n", entry.alias("t")))).alias("e"))
    top = F.array_join(F.transform(F.filter("e", lambda x: ~x["hidden"]), lambda x: x["t"]), "\n")
    low = F.filter("e", lambda x: x["hidden"])
    tail = F.when(F.size(low) > 0, F.concat(F.lit("\n## Hidden by triage ("), F.size(low).cast("string"), F.lit(")\n\n"), F.array_join(F.transform(low, lambda x: x["t"]), "\n"), F.lit("\n"))).otherwise(F.lit(""))
    front = F.concat(F.lit("---\ntype: daily\ndate: "), F.col("day").cast("string"), F.lit("\n---\n\n"))
    return by.select("day", F.concat(front, top, tail).alias("body"))


def write_daily(documents: DataFrame, path: str) -> None:
    """One text file for each day, under path/day=..., replacing that day's."""
    documents.select("body", "day").repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").option("lineSep", "\n").text(path)


def replace_day(digest: DataFrame, path: str) -> None:
    """A day's digest (with its day) as the partition of that day, in place of what it was; other days stay."""
    digest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("errorifexists").json(path)
