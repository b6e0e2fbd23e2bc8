"""Embedding jobs: only what is missing, in batches, with any callable as the model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


DIMENSION = 768


def embed_missing(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, batch: int = 100) -> DataFrame:
    """(chunk_id, embedding, embedding_model) of the chunks without a vector of this model; write it and run again to go on."""
    todo = chunks.filter(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model))).select("chunk_id", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": list(embed(part["text"].fillna("").to_list())), "embedding_model": model})

    return todo.mapInPandas(run, "chunk_id long, embedding array<float>, embedding_model string")


def bucket_of(term: Column, dim: int) -> Column:
    """A 32-bit multiplicative hash of a term's characters, modulo dim."""
    codes = F.transform(F.split(term, ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % F.lit(2**32)) % dim


def hash_embed(df: DataFrame, id: str, text: str, dim: int = DIMENSION) -> DataFrame:
    """(id, embedding): counts of hashed [a-z0-9]+ terms with norm 1, in doubles; a text without terms has all zeros."""
    # lower() gives a dotted capital I a combining dot, which would split its term
    terms = F.filter(F.split(F.lower(F.replace(F.col(text), F.lit("\u0130"), F.lit("i"))), "[^a-z0-9]+"), lambda t: t != "")
    at = df.select(id, F.explode_outer(terms).alias("t")).withColumn("bucket", bucket_of(F.col("t"), dim)).groupBy(id, "bucket").agg(F.count("t").alias("n"))
    norm = at.groupBy(id).agg(F.map_from_entries(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "n")))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    value = lambda i: F.coalesce(F.try_element_at("m", i.cast("long")) / F.nullif(F.col("norm"), F.lit(0.0)), F.lit(0.0))
    return norm.select(id, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value).alias("embedding"))


def validate_vectors(vectors: DataFrame, dim: int = DIMENSION) -> DataFrame:
    return vectors.withColumn("good", F.coalesce(F.size("embedding") == dim, F.lit(False)))


def embedding_status(chunks: DataFrame, model: str | None, by: str = "snapshot_id") -> DataFrame:
    """(by, total, embedded, status): complete, failed, or disabled without a model."""
    done = F.col("embedding").isNotNull() & F.col("embedding_model").eqNullSafe(F.lit(model))
    at = chunks.groupBy(by).agg(F.count("*").alias("total"), F.count_if(done).alias("embedded"))
    return at.withColumn("status", F.lit("disabled") if model is None else F.when(F.col("embedded") == F.col("total"), "complete").otherwise("failed"))


def unit_sum(texts: list[str], dim: int = 16) -> list[list[float]]:
    """A stand-in model: norm-1 sums of character codes; for tests and dry runs."""
    out = []
    for t in texts:
        v = np.bincount(np.frombuffer(t.encode(), dtype=np.uint8) % dim, minlength=dim).astype(float)
        out.append([float(x) for x in v / (np.linalg.norm(v) or 1)])
    return out
