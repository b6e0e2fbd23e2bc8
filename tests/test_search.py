"""Search and embeddings at sizes where ties and rounding show."""

import math

from lodestrata.operators import embedding as E
from lodestrata.operators import search as S


def test_fulltext_ties_are_of_rounded_scores(spark):
    """47 positions and a name, and 147 positions, both score 14.7; their doubles differ in the last bit."""
    chunks = spark.createDataFrame([(1, "s", "runner", "word " * 47), (2, "s", "other", "word " * 147)], "chunk_id long, snapshot_id string, label string, search_text string")
    queries = spark.createDataFrame([(1, "s", "runner word")], "query_id long, snapshot_id string, text string")
    got = S.fulltext_search(queries, S.build_postings(chunks), chunks).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.rank) for r in got] == [(1, 14.7, 1), (2, 14.7, 2)]


def test_hash_embed_is_in_doubles(spark):
    got = E.hash_embed(spark.createDataFrame([(1, "a a b")], "i long, t string"), "i", "t", 64).first().embedding
    assert sorted(got)[-2:] == [1 / math.sqrt(5), 2 / math.sqrt(5)]


def test_approximate_search_makes_no_table_of_pairs(spark):
    """In one bucket every query meets every chunk; no join makes these pairs, only each block's best k come out."""
    c = spark.createDataFrame([(i, "s", "m", [1.0, i / 1000, 0.5]) for i in range(1, 301)], "chunk_id long, snapshot_id string, model string, embedding array<float>")
    q = c.filter("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "snapshot_id", "model", "embedding AS vector")
    seen = []
    of = S._best_of_blocks
    S._best_of_blocks = lambda *a: seen.append(of(*a)) or seen[-1]
    try:
        near = {(r.query_id, r.chunk_id, r["rank"]) for r in S.approximate_vector_search(q, c, 3, bucket=100.0).collect()}
    finally:
        S._best_of_blocks = of
    assert near == {(r.query_id, r.chunk_id, r["rank"]) for r in S.vector_search(q, c, 3).collect()}
    assert seen[0].groupBy("query_id").count().filter("count > 6 * 3").isEmpty()
