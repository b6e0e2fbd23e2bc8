"""The registered queries and their SQL, and the stand-ins that turn the driver's tables into the operators' inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EXTENSIONS = ["ts", "js", "md", "min.js", "js.map", "txt", "tsx", "json", "mdx", "prisma"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files (doc_id, snapshot_id, path, content); some paths are unsafe or in ignored directories."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    lead = F.when(i % 13 == 0, "../").when(i % 11 == 0, "node_modules/").when(i % 7 == 0, "./docs//").otherwise("")
    path = F.concat(lead, F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), i.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (i % 10 + 1).cast("int")))
    return d.select("doc_id", F.col("source").alias("snapshot_id"), path.alias("path"), F.col("text").alias("content"))


FILES = f"""f AS (SELECT doc_id, source AS snapshot_id, text AS content,
  (CASE WHEN doc_id % 13 = 0 THEN '../' WHEN doc_id % 11 = 0 THEN 'node_modules/' WHEN doc_id % 7 = 0 THEN './docs//' ELSE '' END)
  || source || '/' || lang || '/doc_' || doc_id || '.' || ({EXTENSIONS!r})[doc_id % 10 + 1] AS path FROM documents)"""
