"""Text of items from what was fetched: which extractor, and what PDF text needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markup import extract_article

LEAST_WORDS = 50


def pdf_text(text: Column) -> Column:
    """Paragraphs from the text of a PDF: hyphenation at line ends joined, single line ends as blanks."""
    joined = F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")
    lines = F.regexp_replace(joined, r"(?<!\n)\n(?!\n)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"\n{2,}", "\n\n"))


# Fixed value: what a text taken from a PDF starts with.
PDF_NOTICE = "*Extracted from the PDF; layout, formulas and tables may be lost.*"


def pdf_body(text: Column) -> tuple[Column, Column]:
    """(body with its notice, error): too few words are an error."""
    plain = pdf_text(text)
    enough = F.coalesce(F.regexp_count(plain, F.lit(r"\S+")), F.lit(0)) >= LEAST_WORDS
    return F.when(enough, F.concat(F.lit(PDF_NOTICE + "\n\n"), plain)), F.when(~enough, F.lit(f"fewer than {LEAST_WORDS} words"))


def flat_math(html: Column) -> Column:
    """Formulas replaced by their alternative text between dollar signs."""
    return F.regexp_replace(html, r'(?s)<math[^>]*?alttext="([^"]*)"[^>]*>.*?</math>', r" \$$1\$ ")


def extracted(rows: DataFrame) -> DataFrame:
    """rows (item_id, kind, html, pdf) with body, extractor and error: articles from HTML; papers from HTML, else from the PDF."""
    got = rows.withColumn("_a", extract_article(F.when(F.col("kind") == "paper", flat_math(F.col("html"))).otherwise(F.col("html"))))
    pdf, problem = pdf_body(F.col("pdf"))
    use_pdf = (F.col("kind") == "paper") & F.col("_a.body").isNull() & F.col("pdf").isNotNull()
    extractor = F.when(use_pdf & pdf.isNotNull(), "pdf").when(F.col("_a.body").isNotNull(), "html")
    return got.select("item_id", F.when(use_pdf, pdf).otherwise(F.col("_a.body")).alias("body"), extractor.alias("extractor"), F.when(use_pdf, problem).otherwise(F.col("_a.error")).alias("error"))


def feed_summary(entries: DataFrame) -> DataFrame:
    """By feed: usable entries, the newest date, and the titles of the first three usable entries."""
    from pyspark.sql import Window

    usable = entries.where("ok").withColumn("_n", F.row_number().over(Window.partitionBy("feed").orderBy("rank")))
    first = F.array_sort(F.collect_list(F.when(F.col("_n") <= 3, F.struct("_n", "title"))))
    return usable.groupBy("feed").agg(F.count("*").alias("entries"), F.max("published_at").alias("newest"), F.transform(first, lambda x: x["title"]).alias("samples"))
