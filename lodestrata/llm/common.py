"""Helpers shared by the training-data operators: tables, the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A side of a join is broadcast only when its values take at most so many bytes, with ROW_BYTES for each row beside them.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 16


def _in_turn(spark: SparkSession) -> DataFrameReader:
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false")


def table(spark: SparkSession, sf_dir: str, name: str, in_turn: bool = False) -> DataFrame:
    """in_turn: tasks read a file's column chunks one after the other and not all at once, which takes smaller buffers."""
    return (_in_turn(spark) if in_turn else spark.read).parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode a new temporary one if it names none."""
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


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return _in_turn(spark).schema(df.schema).parquet(path)


def _bytes(value: Column, kind: DataType) -> Column:
    """Bytes that a value takes, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value).cast("long"), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        each = kind.elementType
        if isinstance(each, (StringType, BinaryType, ArrayType, StructType, MapType)):
            return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda n, x: n + _bytes(x, each)), F.lit(16))
        return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)).cast("long") * 8 + 16
    if isinstance(kind, MapType):
        return _bytes(F.map_keys(value), ArrayType(kind.keyType)) + _bytes(F.map_values(value), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def size_of(df: DataFrame) -> int:
    """Bytes that the rows of df take in a hash table, about. Measuring runs df's plan: store it before."""
    each = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(ROW_BYTES).cast("long"))
    return df.agg(F.coalesce(F.sum(each), F.lit(0)).alias("n")).first()["n"]


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most that many bytes, else as it is. Measuring runs df's plan: store it before."""
    return F.broadcast(df) if size_of(df) <= most else df


def free(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def look_up(big: DataFrame, key: Column, table: DataFrame, of: str, copies: int = 32) -> DataFrame:
    """big left-joined to table, which has one row for each value of its column of (null equals null). Store table before.

    A small table is broadcast. Beyond that each of its rows is copied and big's rows are dealt among the copies, so
    that a value that a third of big has is still shared out among that many tasks.
    """
    if size_of(table) <= BROADCAST_BYTES:
        return big.join(F.broadcast(table), key.eqNullSafe(F.col(of)), "left")
    deal, copy = free(big, "_deal"), free(big, "_copy")
    dealt = big.withColumn(deal, (F.monotonically_increasing_id() % copies).cast("int"))
    each = table.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return dealt.join(each, key.eqNullSafe(F.col(of)) & (F.col(deal) == F.col(copy)), "left").drop(deal, copy)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else. lower(), which is faster, does the same where all is ASCII."""
    return F.when(col.rlike(r"[^\x00-\x7F]"), F.translate(col, _UPPER, _UPPER.lower())).otherwise(F.lower(col))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
