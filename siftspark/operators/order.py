"""Numbers in a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpoint


def number_rows(rows: DataFrame, *by: Column, name: str = "position") -> DataFrame:
    """rows with their place, from 1, in a total order.

    Ranges of the order are numbered each by itself, then shifted by the sizes of those before; only the
    sizes, one for each range, meet in one place."""
    dealt = checkpoint(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
