"""Bracket pairs and arguments of source texts, at any depth, as tables of positions.

Literals are whole pieces, so that brackets and commas in them count for nothing. A level is the depth inside a pair; within
a file and level an opening bracket, the commas between its arguments and its closing bracket follow one another, so windows
pair them and no rows of a file meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

KEY = ("snapshot_id", "path")


def bracket_rows(files: DataFrame, pieces: Column) -> DataFrame:
    """(key, at, piece, level, line, head, head_line, after_close): each bracket and comma of a file by its offset, the text
    between it and the piece before it, the line that this text starts on, and whether a closing parenthesis stands before that."""
    file = W.partitionBy(*KEY).orderBy("i")
    upto = file.rowsBetween(W.unboundedPreceding, 0)
    at = files.select(*KEY, F.posexplode(pieces).alias("i", "piece"))
    at = at.withColumns({"to": F.sum(F.length("piece")).over(upto), "line": 1 + F.sum(_breaks("piece")).over(upto)})
    at = at.withColumns({"at": F.col("to") - F.length("piece"), "head": F.lag("piece").over(file), "before": F.lag("piece", 2).over(file), "head_line": F.lag("line", 2).over(file)})
    step = F.when(F.col("piece").isin("(", "[", "{"), 1).when(F.col("piece").isin(")", "]", "}"), -1).otherwise(0)
    at = at.withColumn("step", step).withColumn("level", F.sum("step").over(upto) - F.when(F.col("step") < 0, F.col("step")).otherwise(0))
    at = at.filter((F.col("step") != 0) | (F.col("piece") == ","))
    return at.select(*KEY, "at", "piece", "level", "line", "head", F.coalesce("head_line", F.lit(1)).alias("head_line"), (F.col("before") == ")").alias("after_close"))


def _breaks(name: str) -> Column:
    return F.length(name) - F.length(F.replace(F.col(name), F.lit("\n"), F.lit("")))


def arguments(rows: DataFrame) -> DataFrame:
    """rows of opening brackets and commas with opened, the offset of their pair's opening bracket, and first and last, the
    offsets between which the argument after them stands; end is that of the closing bracket, null where it is missing."""
    level = W.partitionBy(*KEY, "level").orderBy("at")
    opens = F.col("piece").isin("(", "[", "{")
    at = rows.withColumns({"opened": F.last(F.when(opens, F.col("at")), ignorenulls=True).over(level.rowsBetween(W.unboundedPreceding, 0)), "last": F.lead("at").over(level)})
    closes = F.when(F.col("piece").isin(")", "]", "}"), F.col("at"))
    at = at.withColumns({"first": F.col("at") + 1, "end": F.first(closes, ignorenulls=True).over(level.rowsBetween(0, W.unboundedFollowing))})
    return at.filter(opens | (F.col("piece") == ","))


def argument_text(text: Column) -> Column:
    """An argument of arguments() in the text that the pieces came from, without the space around it."""
    return F.regexp_replace(F.substring(text, F.col("first") + 1, F.col("last") - F.col("first")), r"^\s+|\s+$", "")
