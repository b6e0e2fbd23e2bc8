"""The folder that all executors share, for tables that cut lineage and for loops."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode a new temporary one where none is named."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"


#: Rows of a task where much is made of each.
TASK_ROWS = 2000


def spread(df: DataFrame, *key: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt out evenly, about rows a task: a table of few bytes is one task's to read, however much is made of each row.

    key: rows of one key go to one task, so that windows and groups of that key need not move what is made of them."""
    n = math.ceil(df.count() / rows)
    return df.repartition(n, *key) if n > 1 else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never a broadcast: it grows with the input. Spark takes a table of few bytes for small,
    however much is made of each row, and would send that through the driver."""
    return df.hint("merge")


def store(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that lineage ends there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
