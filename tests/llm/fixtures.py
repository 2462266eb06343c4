"""Small tables with every odd case: nulls, empty and long texts, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 7))) for _ in range(n))


def rows():
    a, b = prose(1, 120), prose(2, 300)
    near = b.split()
    near[40] = "changed"
    lines = "\n".join(prose(i, 9) for i in range(10, 16))
    out = [(1, a), (2, b), (3, " ".join(near)), (4, a), (5, ""), (6, None), (7, " \n\t "), (8, "x"), (9, "two words"), (10, "Two  WORDS"), (11, lines), (12, prose(3, 5) + "\n" + lines + "\n" + prose(4, 5)), (13, "é" * 500 + a), (14, prose(5, 6000) + b), (15, "ab" * 400), (16, lines + "\n" + lines)]
    out = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in out]
    return out


def documents(spark, more=(), repeat=False):
    data = rows() + list(more)
    if repeat:
        data = data + [data[0], (None, "a null id " + prose(6, 80), "en", "s1", 1), (None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHES = ["_th", "_l", "score", "block", "place", "pii", "n_tokens", "token", "set", "a", "b", "lang_pred", "epoch", "items"]


def clashing(df):
    from pyspark.sql import functions as F

    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df
