"""Repositories and snapshots: registration, admission, access, listings, cached results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def register_snapshots(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """(repo, commit, status): one per commit; existing ones stay, failed ones that are asked for again are queued."""
    asked = requests.select("repo", "commit").distinct().withColumn("asked", F.lit(True))
    at = existing.select("repo", "commit", "status").join(asked, ["repo", "commit"], "full")
    return at.select("repo", "commit", F.when(F.col("status").isNull() | (F.col("asked") & (F.col("status") == "FAILED")), "QUEUED").otherwise(F.col("status")).alias("status"))


def admit_requests(requests: DataFrame, existing: DataFrame, limit: int) -> DataFrame:
    """requests with costs (new or failed commits) and admitted: costing nothing, or within the user's daily limit."""
    at = requests.join(existing.select("repo", "commit", "status"), ["repo", "commit"], "left").withColumn("costs", F.col("status").isNull() | (F.col("status") == "FAILED"))
    n = F.sum(F.col("costs").cast("int")).over(W.partitionBy("user", F.to_date("ts")).orderBy("ts", "request_id").rowsBetween(W.unboundedPreceding, 0))
    return at.withColumn("admitted", ~F.col("costs") | (n <= limit)).drop("status")


def latest(snapshots: DataFrame, by: str = "repo") -> DataFrame:
    w = W.partitionBy(by).orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    return snapshots.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def tracked_repositories(tracked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(user, repo, snapshot_id, status): each tracked repository with its latest snapshot, if any."""
    return tracked.join(latest(snapshots).select("repo", "snapshot_id", "status"), "repo", "left").select("user", "repo", "snapshot_id", "status")


def public_repositories(names: DataFrame, repositories: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Listed names, in any case, with the latest READY snapshot."""
    ready = latest(snapshots.filter("status = 'READY'")).select("repo", "snapshot_id")
    at = repositories.join(names.select(F.lower("name").alias("_n")).distinct(), F.lower("name") == F.col("_n"), "left_semi")
    return at.join(ready, "repo").select("repo", "name", "snapshot_id")


def visible_snapshots(asked: DataFrame, snapshots: DataFrame, tracked: DataFrame, public: DataFrame) -> DataFrame:
    """(viewer, snapshot_id) of asked whose repository the viewer tracks or that is public; the others are absent."""
    at = asked.select("viewer", "snapshot_id").distinct().join(snapshots.select("snapshot_id", "repo"), "snapshot_id")
    mine = tracked.select(F.col("user").alias("viewer"), "repo", F.lit(True).alias("mine")).distinct()
    open_ = public.select("repo", F.lit(True).alias("open")).distinct()
    return at.join(mine, ["viewer", "repo"], "left").join(open_, "repo", "left").filter("mine or open").select("viewer", "snapshot_id")


def list_routes(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    at = routes.join(symbols.select(F.col("symbol_id").alias("handler_symbol_id"), F.col("name").alias("handler")), "handler_symbol_id", "left")
    return at.withColumn("position", F.row_number().over(W.partitionBy("snapshot_id").orderBy("url_path", "method", "route_id")))


def list_files(files: DataFrame) -> DataFrame:
    return files.withColumn("position", F.row_number().over(W.partitionBy("snapshot_id").orderBy("path")))


def outline(symbols: DataFrame) -> DataFrame:
    """(snapshot_id, path, symbols): a file's symbols by start line."""
    each = F.array_sort(F.collect_list(F.struct("start_line", "name", "kind")))
    return symbols.groupBy("snapshot_id", "path").agg(each.alias("symbols"))


def cached(results: DataFrame, snapshots: DataFrame, kind: str, version: int, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(snapshot_id, kind, version, result) for all snapshots: stored ones of this version, others computed anew."""
    have = results.filter((F.col("kind") == kind) & (F.col("version") == version)).select("snapshot_id", "kind", "version", "result")
    missing = snapshots.join(have.select("snapshot_id"), "snapshot_id", "left_anti")
    new = compute(missing).select("snapshot_id", F.lit(kind).alias("kind"), F.lit(version).alias("version"), "result")
    return have.join(snapshots.select("snapshot_id"), "snapshot_id", "left_semi").unionByName(new)
