"""Retrieval evaluation: ranks of gold files, metrics, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

METRICS = ("recall_5", "recall_10", "mrr", "ndcg_10")


def rank_files(results: DataFrame) -> DataFrame:
    """(retriever, question_id, path, rank): each file at the best rank of its chunks, ranked anew."""
    best = results.groupBy("retriever", "question_id", "path").agg(F.min("rank").alias("best"))
    return best.select("retriever", "question_id", "path", F.row_number().over(W.partitionBy("retriever", "question_id").orderBy("best", "path")).alias("rank"))


def score_questions(ranked: DataFrame, questions: DataFrame, retrievers: DataFrame) -> DataFrame:
    """(retriever, question_id, recall_5, recall_10, mrr, ndcg_10), a row for each pair; no gold or no hit gives 0."""
    gold = questions.select("question_id", F.explode(F.array_distinct("gold")).alias("path"))
    hits = ranked.join(gold, ["question_id", "path"]).groupBy("retriever", "question_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in (5, 10)), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1))).alias("gain"))
    n = F.size(F.array_distinct("gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(10))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    at = questions.select("question_id", n.alias("n"), F.when(n > 0, ideal).alias("ideal")).join(retrievers.select("retriever").distinct(), how="cross").join(hits, ["retriever", "question_id"], "left")
    share = lambda x: F.round(F.coalesce(F.when(F.col("n") > 0, x), F.lit(0.0)), 9)
    return at.select("retriever", "question_id", share(F.col("h5") / F.col("n")).alias("recall_5"), share(F.col("h10") / F.col("n")).alias("recall_10"), share(1 / F.col("first")).alias("mrr"), share(F.col("gain") / F.col("ideal")).alias("ndcg_10"))


def summarize(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """Means overall, by type and by repository, as one grouping-sets aggregate; level says which."""
    at = scores.join(questions.select("question_id", "type", "repo"), "question_id")
    sets = [["retriever"], ["retriever", "type"], ["retriever", "repo"]]
    out = at.groupingSets([[F.col(c) for c in s] for s in sets], "retriever", "type", "repo").agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS), F.grouping_id("retriever", "type", "repo").alias("gid"))
    return out.withColumn("level", F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "type").otherwise("repo")).drop("gid")


def percentiles(values: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank 50th and 95th percentiles; 0 where there is no value."""
    at = values.groupBy(by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))
    return at.select(by, F.coalesce("p50", F.lit(0)).alias("p50"), F.coalesce("p95", F.lit(0)).alias("p95"))


def missing_gold(questions: DataFrame, files: DataFrame) -> DataFrame:
    gold = questions.select("question_id", "repo", F.explode("gold").alias("path"))
    return gold.join(files.select(F.col("snapshot_id").alias("repo"), "path"), ["repo", "path"], "left_anti")


def best_labels(reports: DataFrame, metric: str, by: str) -> DataFrame:
    """(by, retriever): those within 1e-9 of the best of their group."""
    return reports.withColumn("_best", F.max(metric).over(W.partitionBy(by))).filter(F.col(metric) >= F.col("_best") - 1e-9).select(by, "retriever")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("kind").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


def run_config(questions: DataFrame) -> DataFrame:
    return questions.groupBy("repo").agg(F.count("*").alias("questions"), F.count_if(F.col("source") == "hand").alias("hand"), F.count_if(F.col("source") != "hand").alias("generated"), F.count_if("reviewed").alias("reviewed"))


def run_matrix(lists: dict[str, DataFrame], chunks: DataFrame, k: int = 20, files: int = 10) -> DataFrame:
    """(retriever, question_id, path, rank): every retriever's first k chunks as its first files."""
    rows = None
    for name, ranked in lists.items():
        r = ranked.filter(F.col("rank") <= k).join(chunks.select("chunk_id", "path"), "chunk_id").select(F.lit(name).alias("retriever"), F.col("query_id").alias("question_id"), "path", "rank")
        rows = r if rows is None else rows.union(r)
    return rank_files(rows).filter(F.col("rank") <= files)
