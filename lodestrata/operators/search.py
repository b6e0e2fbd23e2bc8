"""Retrieval for tables of queries over many snapshots: full text, vectors, fusion, expansion, fuzzy paths."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.functions.text import query_identifiers, query_terms, snippet, tokens
from lodestrata.sources.shared import spread, store

#: Candidates of each list, seeds and results of an expansion, and how much of a seed's score a neighbour gets.
CANDIDATES, SEEDS, EXPANDED, CARRIED = 30, 5, 6, 0.5
#: Vectors of a block, about; copies of a snapshot's path queries.
BLOCK, DEALT = 4096, 16
#: Pairs of a text and a path that a task places, about.
PAIRS = 100_000
#: Rank constant of reciprocal rank fusion; what an exact name match adds to a text score.
RRF, NAME_BOOST = 60, 10.0


def top(df: DataFrame, k: int, *order: Column, by: str | list[str] = "query_id") -> DataFrame:
    """The first k rows of each by, with rank from 1; Spark keeps k per partition before it shuffles."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def build_postings(chunks: DataFrame) -> DataFrame:
    """(snapshot_id, term, lead, chunk_id, positions): positions of each term of search_text."""
    at = chunks.select("snapshot_id", "chunk_id", F.posexplode(tokens(F.col("search_text"))).alias("pos", "term"))
    return at.groupBy("snapshot_id", "term", "chunk_id").agg(F.count("*").alias("positions")).withColumn("lead", F.substring("term", 1, 2))


def fulltext_search(queries: DataFrame, postings: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, score, rank, sources): any of a query's terms as a prefix.

    The score is 0.1 for each different position that matches, and NAME_BOOST more if the label, or its part after the
    last dot, is one of the query's identifiers. Query terms are matched with the vocabulary first (on two leading
    characters), so that each posting is joined once, on its whole term.
    """
    asked = queries.select("query_id", "snapshot_id", F.explode(query_terms(F.col("text"))).alias("q")).withColumn("lead", F.substring("q", 1, 2))
    vocabulary = postings.select("snapshot_id", "lead", "term").distinct()
    wanted = asked.join(vocabulary, ["snapshot_id", "lead"]).filter(F.col("term").startswith(F.col("q"))).select("query_id", "snapshot_id", "term").distinct()
    found = wanted.join(postings, ["snapshot_id", "term"]).groupBy("query_id", "chunk_id").agg((F.sum("positions") * 0.1).alias("score"))
    labels = chunks.select("chunk_id", F.lower("label").alias("label"))
    names = queries.select("query_id", query_identifiers(F.col("text")).alias("names"))
    named = F.array_contains("names", F.col("label")) | F.array_contains("names", F.substring_index("label", ".", -1))
    scored = found.join(labels, "chunk_id", "left").join(names, "query_id").withColumn("score", F.round(F.col("score") + F.when(named, NAME_BOOST).otherwise(0.0), 9))
    return top(scored, k, F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id", "score", "rank", F.array(F.lit("fulltext")).alias("sources"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _nearest(k: int):
    """The k best chunks of each query of two blocks, by one matrix product; ties by id."""

    def of(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": q["query_id"][:0], "chunk_id": c["chunk_id"][:0], "score": np.zeros(0)})
        a, b = (np.stack(x.to_list()).astype(float) for x in (q["vector"], c["embedding"]))
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.round((a @ b.T) / np.sqrt((a * a).sum(1))[:, None] / np.sqrt((b * b).sum(1))[None], 9)
        score = np.where(np.isfinite(score), score, -np.inf)
        ids, n, out = c["chunk_id"].to_numpy(), min(k, len(c)), []
        least = -np.partition(-score, n - 1, axis=1)[:, n - 1]
        for i, query in enumerate(q["query_id"]):
            at = np.nonzero((score[i] >= least[i]) & (score[i] > -np.inf))[0]
            at = at[np.lexsort((ids[at], -score[i][at]))][:k]
            out.append(pd.DataFrame({"query_id": query, "chunk_id": ids[at], "score": score[i][at]}))
        return pd.concat(out, ignore_index=True)

    return of


def _vectors(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, snapshot_id, model, dim, vector) with columns of its own, so that a table can be searched for its own rows."""
    of = df.filter(F.col(vector).isNotNull()).select(*(F.col(c).alias(c) for c in (id, "snapshot_id", "model", vector)))
    return of.withColumn("dim", F.size(vector))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, chunk_id, score, rank, sources): exact cosine similarity among chunks of the query's snapshot and model.

    Within a snapshot and model, queries and chunks are dealt by hash to blocks of about BLOCK vectors, as many as these
    need; every block of queries meets every block of chunks there, and each meeting gives its best k. So no task holds
    more than two blocks, and small snapshots are sent once. Vectors of another length, and zero vectors, are nobody's
    neighbours.
    """
    q, c = _vectors(queries, "query_id", "vector"), _vectors(chunks, "chunk_id", "embedding")
    best = _best_of_blocks(q, c, ["snapshot_id", "model", "dim"], k)
    return top(best, k, F.desc("score"), F.col("chunk_id")).withColumn("sources", F.array(F.lit("vector")))


def _best_of_blocks(q: DataFrame, c: DataFrame, key: list[str], k: int) -> DataFrame:
    """(query_id, chunk_id, score): the k best of each meeting of a block of queries and one of chunks that share key."""
    blocks = lambda df, n: df.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    nq, nc = blocks(q, "nq"), blocks(c, "nc")
    sizes = store(nq.join(nc, _same(nq, nc, key)).select(*(nq[x] for x in key), "nq", "nc"), "vector-blocks")
    deal = lambda id, n: F.pmod(F.xxhash64(id), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Spark broadcasts the sizes if they are small; keys of many rows are split by adaptive execution
    q = q.join(sizes, _same(q, sizes, key)).select("query_id", *(q[x] for x in key), "vector", deal("query_id", "nq").alias("qb"), every("nc").alias("cb"))
    c = c.join(sizes, _same(c, sizes, key)).select("chunk_id", *(c[x].alias(x) for x in key), "embedding", deal("chunk_id", "nc").alias("cb"), every("nq").alias("qb"))
    by, kind = [*key, "qb", "cb"], lambda df, x: df.schema[x].dataType.simpleString()
    return q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(_nearest(k), f"query_id {kind(q, 'query_id')}, chunk_id {kind(c, 'chunk_id')}, score double")


def approximate_vector_search(queries: DataFrame, chunks: DataFrame, k: int = CANDIDATES, bucket: float = 0.5, tables: int = 6, radius: float = math.inf) -> DataFrame:
    """The same by random projections of unit vectors, then exact scores of those that met, within radius if one is given.

    Buckets are keyed by snapshot, model, table and hash, so no pair of two snapshots is ever made. Buckets are scored by
    blocks as vector_search does, and only each meeting's best k leave it. Chunks of the most common length are hashed. A query for which fewer than k met is searched exactly among all chunks (within radius).
    """
    size = F.sqrt(dot(F.col("v"), F.col("v")))

    def units(df: DataFrame, id: str, vector: str) -> DataFrame:
        of = _vectors(df, id, vector).withColumnRenamed(vector, "v").withColumn("size", size).filter((F.col("size") > 0) & (F.col("size") < math.inf))
        return of.select(id, "snapshot_id", "model", "dim", F.transform("v", lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("size")), F.lit(0.0))).alias("u"))

    c = units(chunks, "chunk_id", "embedding")
    dim = c.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dim:
        return vector_search(queries, chunks, k)
    # stored, since Spark would else hash rows before it leaves them out
    c, q = (store(df.filter(F.col("dim") == dim[0]["dim"]), "unit-vectors").withColumn("x", array_to_vector("u")) for df in (c, units(queries, "query_id", "vector")))
    lsh = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=7).fit(c)

    def buckets(df: DataFrame, *of: str | Column) -> DataFrame:
        at = lsh.transform(df).select(*of, "snapshot_id", "model", F.posexplode("h").alias("t", "b"))
        return at.withColumn("b", F.get(vector_to_array("b"), F.lit(0)))

    asked, held = buckets(q, "query_id", F.col("u").alias("vector")), buckets(c, "chunk_id", F.col("u").alias("embedding"))
    met = _best_of_blocks(asked, held, ["snapshot_id", "model", "t", "b"], k)
    exact = met.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    within = lambda df: df.filter(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))) < radius) if radius < 2 else df
    near = store(top(within(exact), k, F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id", "score", "rank"), "near-vectors")
    short = queries.join(near.filter(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    rest = within(vector_search(short, chunks, k).drop("sources"))
    whole = near.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)
    return whole.withColumn("sources", F.array(F.lit("vector")))


def rrf(*ranked: DataFrame, k: int = RRF) -> DataFrame:
    """Reciprocal rank fusion: 1 / (k + rank) summed over the lists, with the sources of all of them."""
    rows = None
    for r in ranked:
        r = r.select("query_id", "chunk_id", "rank", "sources")
        rows = r if rows is None else rows.union(r)
    # rounding each share makes the sum the same in whatever order it is taken
    share = (F.lit(1) / (F.lit(k) + F.col("rank"))).cast("decimal(20,15)")
    fused = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(share).cast("double"), 12).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def expand_calls(ranked: DataFrame, symbols: DataFrame, calls: DataFrame, chunks: DataFrame, seeds: int = SEEDS, most: int = EXPANDED) -> DataFrame:
    """One hop over resolved calls, both ways, from symbols that start in a seed chunk; each neighbour's tightest chunk."""
    spans = chunks.select("chunk_id", F.col("snapshot_id").alias("c_snapshot"), F.col("path").alias("c_path"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))
    seed = ranked.filter(F.col("rank") <= seeds).select("query_id", "chunk_id", "score").join(spans, "chunk_id")
    places = symbols.select("symbol_id", "snapshot_id", "path", "start_line")
    inside = (F.col("snapshot_id") == F.col("c_snapshot")) & (F.col("path") == F.col("c_path")) & F.col("start_line").between(F.col("c_start"), F.col("c_end"))
    start = seed.join(places, inside).select("query_id", "symbol_id", "score")
    links = calls.filter("resolved and from_symbol_id is not null and to_symbol_id is not null").select(F.col("from_symbol_id").alias("a"), F.col("to_symbol_id").alias("b"))
    both = links.union(links.select("b", "a")).distinct()
    near = start.join(both, F.col("symbol_id") == F.col("a")).groupBy("query_id", F.col("b").alias("symbol_id")).agg(F.max("score").alias("score"))
    at = near.join(places, "symbol_id").join(spans, inside)
    tight = at.groupBy("query_id", "symbol_id").agg(F.min_by("chunk_id", F.struct(F.col("c_end") - F.col("c_start"), F.col("chunk_id"))).alias("chunk_id"), F.max("score").alias("score"))
    found = tight.groupBy("query_id", "chunk_id").agg(F.round(F.max("score") * CARRIED, 12).alias("score")).join(ranked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return top(found, most, F.desc("score"), F.col("chunk_id")).withColumn("sources", F.array(F.lit("graph")))


def hybrid_search(lists: list[DataFrame], k: int, graph: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fuse the lists' candidates, keep k, add what graph makes of them, and keep k of all by score."""
    fused = rrf(*(r.filter(F.col("rank") <= CANDIDATES) for r in lists)).filter(F.col("rank") <= k)
    cols = ["query_id", "chunk_id", "score", "sources"]
    both = fused.select(*cols).union(graph(fused).select(*cols)) if graph else fused.select(*cols)
    return top(both, k, F.desc("score"), F.col("chunk_id"))


def hydrate(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """ranked with its chunks' columns; ids that are gone drop out, rank and score stay."""
    return ranked.join(chunks, "chunk_id")


def search_response(ranked: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hydrated rows with snippets; k is held within 1 to 30 and queries over 500 characters give nothing."""
    k = max(1, min(30, k))
    fit = queries.filter(F.length("text") <= 500).select("query_id")
    got = hydrate(ranked.filter(F.col("rank") <= k).join(fit, "query_id", "left_semi"), chunks)
    return got.withColumn("snippet", snippet(F.col("content")))


def _tightest(path: Column, query: Column) -> Column:
    """struct(spread, places) of the tightest in-order placement of query's characters, leftmost among equals; null if none."""
    chars = F.split(query, "")
    starts = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: F.substring(path, i, F.lit(1)) == F.substring(query, F.lit(1), F.lit(1)))

    def place(i: Column) -> Column:
        first = F.array(i.cast("int"))
        rest = F.slice(chars, F.lit(2), F.greatest(F.length(query) - 1, F.lit(0)))

        def step(acc: Column, c: Column) -> Column:
            at = F.call_function("locate", c, path, F.element_at(acc, F.lit(-1)) + 1)
            return F.when(F.element_at(acc, F.lit(-1)) == 0, acc).otherwise(F.concat(acc, F.array(at)))

        return F.aggregate(rest, first, step)

    whole = F.filter(F.transform(starts, place), lambda p: F.element_at(p, F.lit(-1)) > 0)
    return F.array_min(F.transform(whole, lambda p: F.struct((F.element_at(p, F.lit(-1)) - F.get(p, F.lit(0)) + 1).alias("spread"), p.alias("places"))))


def fuzzy_paths(queries: DataFrame, files: DataFrame, k: int = 8) -> DataFrame:
    """(query_id, path, score, rank): in-order matches of a query's characters in the paths of its snapshot.

    A substring of the file name, at its start, or elsewhere in the path earns 40, 60 and 20; each character 1, or 3
    right after the one before, and 1 more in the file name; longer paths lose a hundredth each. A placement wider
    than max(2 x length, 8) counts only if the query is a substring.
    """
    q = queries.select("query_id", "snapshot_id", F.lower(F.regexp_replace("text", r"\s", "")).alias("q")).filter("q <> ''")
    # each different text is placed once; paths are dealt to tasks by how many texts meet them, since their bytes are few
    q = q.distinct()
    texts, paths = store(q.select("snapshot_id", "q").distinct(), "path-texts"), store(files.select("snapshot_id", "path").distinct(), "paths")
    most = texts.groupBy("snapshot_id").count().agg(F.max("count")).first()[0] or 1
    dealt = spread(paths, rows=max(1, PAIRS // most)).withColumn("deal", F.pmod(F.xxhash64("path"), F.lit(DEALT)).cast("int"))
    at = texts.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).join(dealt, ["snapshot_id", "deal"]).drop("deal").withColumn("low", F.lower("path"))
    loose = F.concat(F.lit("%"), F.array_join(F.transform(F.split("q", ""), lambda c: F.when(c.isin("%", "_", "\\"), F.concat(F.lit("\\"), c)).otherwise(c)), "%"), F.lit("%"))
    at = at.withColumn("loose", loose).filter(F.expr("low LIKE loose")).withColumn("t", _tightest(F.col("low"), F.col("q"))).filter("t is not null")
    name_at = F.length("low") - F.length(F.substring_index("low", "/", -1)) + 1
    name = F.substring_index("low", "/", -1)
    sub = F.col("low").contains(F.col("q"))
    bonus = F.when(name.startswith(F.col("q")), 60.0).when(name.contains(F.col("q")), 40.0).when(sub, 20.0).otherwise(0.0)
    each = F.aggregate(F.transform("t.places", lambda p, i: F.when((i > 0) & (F.get(F.col("t.places"), i - 1) == p - 1), 3).otherwise(1) + F.when(p >= F.col("name_at"), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    at = at.withColumn("name_at", name_at).filter(sub | (F.col("t.spread") <= F.greatest(F.length("q") * 2, F.lit(8))))
    at = at.select("snapshot_id", "q", "path", F.round(bonus + each - F.length("path") / 100, 9).alias("score"))
    order = F.desc("score"), F.length("path"), F.col("path")
    best = store(top(at, k, *order, by=["snapshot_id", "q"]).drop("rank"), "path-hits")
    return top(q.join(best, ["snapshot_id", "q"]).select("query_id", "path", "score"), k, *order)


def lookup(paths: DataFrame, fulltext: DataFrame, queries: DataFrame, n_paths: int = 6, n_chunks: int = 12) -> DataFrame:
    """(query_id, section, item, rank): path hits, then text hits of queries of two characters or more."""
    long = queries.filter(F.length(F.trim("text")) >= 2).select("query_id")
    a = paths.filter(F.col("rank") <= n_paths).select("query_id", F.lit("path").alias("section"), F.col("path").alias("item"), "rank")
    b = fulltext.filter(F.col("rank") <= n_chunks).join(long, "query_id", "left_semi").select("query_id", F.lit("text").alias("section"), F.col("chunk_id").cast("string").alias("item"), "rank")
    return a.unionByName(b)


def followup_queries(messages: DataFrame, short: int = 12) -> DataFrame:
    """(session_id, turn, query): user questions of fewer than short words are led by the user question before them."""
    users = messages.filter("role = 'user'").withColumn("before", F.lag("content").over(W.partitionBy("session_id").orderBy("turn")))
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    return users.select("session_id", "turn", F.when((words < short) & F.col("before").isNotNull(), F.concat_ws("\n", "before", "content")).otherwise(F.col("content")).alias("query"))
