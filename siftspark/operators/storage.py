"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and no other was chosen, a folder of this machine, if all of Spark is on it; else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "siftspark-checkpoints"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; it goes with the session."""
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: df written as a table in the shared folder, and read again. It is computed once, and its plan is no more than a scan; Dataset.checkpoint() computes twice and keeps the plan's constraints."""
    where = new_folder(df.sparkSession, "checkpoint")
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A path with what tells one state of its files from another: sizes and times."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path + "".join(f" {f.getLen()}@{f.getModificationTime()}" for f in files or [])
