"""The corpus pipeline: documents in, a mixed and cleaned corpus out.

STAGES are (name, function) in order. A function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's
docs; all but the last return the columns that they got.

- language_id drops documents whose language can't be told ('und', or a score
  under LEAST_SCORE).
- line_dedup removes later occurrences of three-line windows, and documents that
  have lost lines and have no text left.
- ngram_join keeps one document of each group of near copies: linked by at least
  80 % of their shingles of five words.
- decontaminate drops documents that hold a window of the benchmark.
- mixing takes documents by the weights of their sources; one row for each time.

Nulls, repeated rows, ties and empty tables: as the operators say; documents
with null or empty text have no language and go in the first stage. Columns of
documents keep their values in the first four stages, whatever their names, but
for text and n_chars where lines go; in the last, those called n_tokens, weight,
epoch, block and place give way to the mix's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import decontaminate as _decontaminate
from siftspark.llm import language as _language
from siftspark.llm import line_dedup as _line_dedup
from siftspark.llm import mixing as _mixing
from siftspark.llm import ngram_join as _ngram_join
from siftspark.llm.common import packed, shared_folder, unpacked

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = _language.identify(docs.select(packed(docs), "text"), _language.train(docs))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*unpacked(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = _line_dedup.dedup_lines(docs.select("doc_id", "text", packed(docs, "text")))
    left = left.where("n_removed = 0 OR rlike(text, '[^ \\t\\r\\n]')")
    values = {c: F.col(f"_row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in values:
        values["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.select(*[values[c].alias(c) for c in docs.columns])


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _ngram_join.dedup(docs, 5, 80).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

#: A language model decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is in the shared folder, and goes with the session."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
