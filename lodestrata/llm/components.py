"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import store


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.toDF("a", "b")).distinct()


def _is_stars(e: DataFrame) -> bool:
    """Each lower end is a centre only, each upper end has one centre."""
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").limit(1).count() == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b) that is not the least of its component.

    component is the least node reachable. Repeated, reversed and self links are allowed; nulls link nothing; no links
    give an empty table. Minima are taken before each join, so a node with any number of links costs no single task
    more than its share. Each round is written to the shared folder; the number of rounds grows with the logarithm of
    the longest path, and the loop fails rather than stop early.
    """
    a, b = edges.columns
    e = store(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").filter(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), "links")
    for _ in range(rounds):
        if _is_stars(e):
            return e.toDF("node", "component")
        e = store(_small_star(_large_star(e)), "links")
    raise RuntimeError(f"components: not settled after {rounds} rounds")
