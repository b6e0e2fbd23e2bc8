"""Queries of retrieval (F) and its evaluation (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import evaluation as K
from lodestrata.operators import search as S
from lodestrata.plans.registry import query, table
from lodestrata.sources.shared import store

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of a line span; the label is the first word."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat("source", F.lit("/f"), (i % 50).cast("string"), F.lit(".ts"))
    return d.select(i.alias("chunk_id"), F.col("source").alias("snapshot_id"), path.alias("path"), F.regexp_extract("text", "([A-Za-z]+)", 1).alias("label"), F.col("text").alias("content"), F.col("text").alias("search_text"), "lang")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("snapshot_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("label") % 2).cast("string").alias("snapshot_id"), F.lit("m1").alias("model"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter("chunk_id % 20 = 0").select((F.col("chunk_id") / 20).cast("long").alias("query_id"), "snapshot_id", "model", F.col("embedding").alias("vector"))


def fulltext(spark: SparkSession, sf_dir: str, k: int = S.CANDIDATES) -> DataFrame:
    """Two scans of the texts, one for the postings and one for the labels; both and the result are stored."""
    c = chunks(spark, sf_dir)
    postings, labels = store(S.build_postings(c), "postings"), store(c.select("chunk_id", "label"), "labels")
    return store(S.fulltext_search(queries(spark, sf_dir), postings, labels, k), "fulltext")


def vector(spark: SparkSession, sf_dir: str, k: int = S.CANDIDATES) -> DataFrame:
    return store(S.vector_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), k), "nearest")


_CTE = f"""c AS (SELECT doc_id AS chunk_id, source AS snapshot_id, source || '/f' || doc_id % 50 || '.ts' AS path, regexp_extract(text, '([A-Za-z]+)', 1) AS label, text FROM documents),
q AS (SELECT item_id AS query_id, 'src' || item_id % 20 AS snapshot_id, text FROM benchmark),
po AS (SELECT snapshot_id, chunk_id, t AS term, count(*) AS positions FROM (SELECT snapshot_id, chunk_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+'))) AS t FROM c) GROUP BY ALL),
qw AS (SELECT query_id, snapshot_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+'))) AS t, unnest(range(1, len(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+')) + 1)) AS i FROM q),
qd AS (SELECT query_id, snapshot_id, t, min(i) AS i FROM qw WHERE length(t) > 1 AND t NOT IN ({_STOP}) GROUP BY ALL),
qt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS n FROM qd) WHERE n <= 24),
wt AS (SELECT DISTINCT query_id, qt.snapshot_id, term FROM qt JOIN (SELECT DISTINCT snapshot_id, term FROM po) v ON v.snapshot_id = qt.snapshot_id AND starts_with(term, t)),
fs AS (SELECT query_id, chunk_id, sum(positions) * 0.1 AS s FROM wt JOIN po USING (snapshot_id, term) GROUP BY ALL),
fn AS (SELECT query_id, chunk_id, s::DOUBLE + CASE WHEN EXISTS (SELECT 1 FROM qw WHERE qw.query_id = fs.query_id AND qw.t = lower(label) AND length(qw.t) > 2 AND qw.t NOT IN ({_STOP})) THEN 10 ELSE 0 END AS score FROM fs JOIN c USING (chunk_id)),
ft AS (SELECT query_id, chunk_id, round(score, 9) AS score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS n FROM fn) WHERE n <= 30),
e AS (SELECT vec_id AS chunk_id, label % 2 AS g, embedding::DOUBLE[] AS v FROM embeddings),
vp AS (SELECT a.chunk_id // 20 AS query_id, b.chunk_id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a JOIN e b ON a.g = b.g WHERE a.chunk_id % 20 = 0),
vs AS (SELECT query_id, chunk_id, score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM vp) WHERE n <= 30),
rr AS (SELECT query_id, chunk_id, round(sum((1 / (60 + rank))::DECIMAL(20,15))::DOUBLE, 12) AS score, string_agg(src, ',' ORDER BY src) AS sources FROM (SELECT query_id, chunk_id, rank, 'fulltext' AS src FROM ft UNION ALL SELECT query_id, chunk_id, rank, 'vector' FROM vs) GROUP BY ALL)"""


@query("f1_query_terms", f"WITH {_CTE} SELECT query_id, string_agg(t, ' ' ORDER BY n) AS terms FROM qt GROUP BY query_id")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).select("query_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query("f2_query_identifiers", f"WITH {_CTE}, x AS (SELECT query_id, t, min(i) AS i FROM qw WHERE length(t) > 2 AND NOT regexp_matches(t, '^[0-9]') AND t NOT IN ({_STOP}) GROUP BY ALL) SELECT query_id, string_agg(t, ' ' ORDER BY i) AS names FROM x GROUP BY query_id")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries(spark, sf_dir).select("query_id", F.array_join(T.query_identifiers(F.col("text")), " ").alias("names"))


@query("f3_build_postings", f"WITH {_CTE} SELECT snapshot_id, chunk_id, term, substr(term, 1, 2) AS lead, positions FROM po")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.build_postings(chunks(spark, sf_dir))


@query("f4_fulltext_search", f"WITH {_CTE} SELECT query_id, chunk_id, score, rank FROM ft")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext(spark, sf_dir).drop("sources")


@query("f5_vector_search", f"WITH {_CTE} SELECT * FROM vs")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector(spark, sf_dir).drop("sources")


@query("f6_approximate_vectors")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.approximate_vector_search(vector_queries(spark, sf_dir), vectors(spark, sf_dir)).drop("sources")


@query("f7_rank_fusion", f"WITH {_CTE} SELECT query_id, chunk_id, score, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rr")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rrf(fulltext(spark, sf_dir), vector(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


def _code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as symbols of ten lines in fifty files, spans of fifty lines as chunks, shipments as calls."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"))
    path = F.concat(F.lit("p"), (F.col("symbol_id") % 50).cast("string"))
    start = (F.floor(F.col("symbol_id") / 50) * 10 + 1).cast("int")
    symbols = p.select("symbol_id", F.lit("s").alias("snapshot_id"), path.alias("path"), start.alias("start_line"), (start + 9).alias("end_line"))
    first = F.floor((F.col("start_line") - 1) / 30) * 30 + 1
    spans = symbols.select("snapshot_id", "path", first.cast("int").alias("start_line")).distinct().withColumn("end_line", F.col("start_line") + 29)
    spans = spans.withColumn("chunk_id", F.regexp_extract("path", "([0-9]+)", 1).cast("long") * 100000 + F.col("start_line"))
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("from_symbol_id"), F.col("l_partkey").alias("to_symbol_id"), F.lit(True).alias("resolved")).distinct()
    return symbols, spans, calls


_CODE = """sy AS (SELECT p_partkey AS symbol_id, 'p' || p_partkey % 50 AS path, (p_partkey // 50) * 10 + 1 AS s FROM part),
sp AS (SELECT DISTINCT path, ((s - 1) // 30) * 30 + 1 AS cs, regexp_extract(path, '([0-9]+)', 1)::BIGINT * 100000 + ((s - 1) // 30) * 30 + 1 AS chunk_id FROM sy),
lk AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), bo AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
sd AS (SELECT query_id, chunk_id, score FROM (SELECT cs // 30 % 7 AS query_id, chunk_id, round(1.0 / (60 + row_number() OVER (PARTITION BY cs // 30 % 7 ORDER BY chunk_id)), 12)::DOUBLE AS score, row_number() OVER (PARTITION BY cs // 30 % 7 ORDER BY chunk_id) AS n FROM sp) WHERE n <= 10),
st AS (SELECT query_id, symbol_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS n FROM sd) JOIN sp USING (chunk_id) JOIN sy ON sy.path = sp.path AND s BETWEEN cs AND cs + 29 WHERE n <= 5),
ne AS (SELECT query_id, b AS symbol_id, max(score) AS score FROM st JOIN bo ON a = symbol_id GROUP BY ALL),
ch AS (SELECT query_id, chunk_id, round(max(score) * 0.5, 12) AS score FROM ne JOIN sy USING (symbol_id) JOIN sp ON sp.path = sy.path AND s BETWEEN cs AND cs + 29 GROUP BY ALL),
ex AS (SELECT query_id, chunk_id, score, n AS rank FROM (SELECT ch.*, row_number() OVER (PARTITION BY ch.query_id ORDER BY ch.score DESC, ch.chunk_id) AS n FROM ch ANTI JOIN sd ON ch.query_id = sd.query_id AND ch.chunk_id = sd.chunk_id) WHERE n <= 6)"""


def _seeded(spans: DataFrame) -> DataFrame:
    at = S.top(spans.select((F.floor(F.col("start_line") / 30) % 7).alias("query_id"), "chunk_id"), 10, F.col("chunk_id"))
    return at.withColumn("score", F.round(1 / (60 + F.col("rank")), 12)).withColumn("sources", F.array(F.lit("fulltext")))


@query("f8_expand_calls", f"WITH {_CODE} SELECT * FROM ex")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, spans, calls = _code(spark, sf_dir)
    return S.expand_calls(_seeded(spans), symbols, calls, spans).drop("sources")


@query("f9_graph_hybrid", f"WITH {_CODE}, u AS (SELECT query_id, chunk_id, score, 'fulltext' AS sources FROM sd UNION ALL SELECT query_id, chunk_id, score, 'graph' FROM ex) SELECT query_id, chunk_id, score, sources, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM u) WHERE n <= 10")
def f9_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, spans, calls = _code(spark, sf_dir)
    got = S.hybrid_search([_seeded(spans)], 10, lambda r: S.expand_calls(r, symbols, calls, spans))
    return got.withColumn("sources", F.array_join("sources", ","))


@query("f9_hybrid_search", f"WITH {_CTE} SELECT query_id, chunk_id, score, sources, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM rr) WHERE n <= 10")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hybrid_search([fulltext(spark, sf_dir), vector(spark, sf_dir)], 10).withColumn("sources", F.array_join("sources", ","))


@query("f10_hydrate", f"WITH {_CTE} SELECT query_id, chunk_id, rank, score, path, md5(text) AS h FROM ft JOIN c USING (chunk_id)")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hydrate(fulltext(spark, sf_dir), chunks(spark, sf_dir)).select("query_id", "chunk_id", "rank", "score", "path", F.md5("content").alias("h"))


def _fuzzy_sql(queries: str, paths: str) -> str:
    """CTEs that end in fz (query_id, path, score, rank): the placement is built character by character from each start."""
    return f"""fq AS ({queries}), fp AS ({paths}),
fc AS (SELECT query_id, q, path, low, len(low) - len(string_split(low, '/')[-1]) + 1 AS name_at, string_split(low, '/')[-1] AS fname FROM fq JOIN fp USING (snapshot_id)),
fst AS (SELECT *, unnest(list_filter(range(1, len(low) + 1), lambda i: low[i] = q[1])) AS s FROM fc),
fr(query_id, q, path, low, name_at, fname, s, j, pos, points) AS (SELECT query_id, q, path, low, name_at, fname, s, 1, s, 1 + (s >= name_at)::INT FROM fst
 UNION ALL SELECT query_id, q, path, low, name_at, fname, s, j + 1, pos + instr(low[pos + 1:], q[j + 1]), points + CASE WHEN instr(low[pos + 1:], q[j + 1]) = 1 THEN 3 ELSE 1 END + (pos + instr(low[pos + 1:], q[j + 1]) >= name_at)::INT FROM fr WHERE j < len(q) AND instr(low[pos + 1:], q[j + 1]) > 0),
fb AS (SELECT query_id, q, path, low, fname, min((pos - s + 1, s, points)) AS b FROM fr WHERE j = len(q) GROUP BY ALL),
fo AS (SELECT query_id, path, round(CASE WHEN starts_with(fname, q) THEN 60 WHEN contains(fname, q) THEN 40 WHEN contains(low, q) THEN 20 ELSE 0 END + b[3] - len(path) / 100, 9)::DOUBLE AS score FROM fb WHERE contains(low, q) OR b[1] <= greatest(len(q) * 2, 8)),
fz AS (SELECT query_id, path, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, len(path), path) AS rank FROM fo) WHERE rank <= 8)"""


_PATHS = "SELECT DISTINCT 's' AS snapshot_id, path, lower(path) AS low FROM (SELECT regexp_extract(url, '//(.*)$', 1) AS path FROM pages)"
_F11 = _fuzzy_sql("SELECT page_id AS query_id, 's' AS snapshot_id, lower(substr(p, 1, 3) || substr(string_split(p, '/')[-1], 1, 2)) AS q FROM (SELECT page_id, regexp_extract(url, '//(.*)$', 1) AS p FROM pages WHERE page_id % 20 = 0)", _PATHS)


@query("f11_fuzzy_paths", f"WITH RECURSIVE {_F11} SELECT * FROM fz")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.lit("s").alias("snapshot_id"), F.regexp_extract("url", "//(.*)$", 1).alias("path"))
    q = p.filter("page_id % 20 = 0").select(F.col("page_id").alias("query_id"), "snapshot_id", F.concat(F.substring("path", 1, 3), F.substring(T.file_name(F.col("path")), 1, 2)).alias("text"))
    return S.fuzzy_paths(q, p)


@query("f13_search_response", f"WITH {_CTE} SELECT query_id, chunk_id, rank, score FROM ft JOIN q USING (query_id) WHERE rank <= 5 AND length(q.text) <= 500")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_response(fulltext(spark, sf_dir), chunks(spark, sf_dir), queries(spark, sf_dir), 5).select("query_id", "chunk_id", "rank", "score")


_F14 = _fuzzy_sql("SELECT item_id AS query_id, 'src' || item_id % 20 AS snapshot_id, lower(regexp_replace(regexp_extract(text, '([A-Za-z]+)', 1), '\\s', '', 'g')) AS q FROM benchmark", "SELECT DISTINCT source AS snapshot_id, source || '/f' || doc_id % 50 || '.ts' AS path, lower(source || '/f' || doc_id % 50 || '.ts') AS low FROM documents")


@query("f14_lookup", f"WITH RECURSIVE {_CTE}, {_F14} SELECT query_id, 'path' AS section, path AS item, rank FROM fz WHERE rank <= 6 UNION ALL SELECT query_id, 'text', chunk_id::VARCHAR, rank FROM ft JOIN q USING (query_id) WHERE rank <= 12 AND length(trim(q.text)) >= 2")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are looked up by the first word of each query, texts by the whole of it."""
    q = queries(spark, sf_dir)
    word = q.withColumn("text", F.regexp_extract("text", "([A-Za-z]+)", 1))
    return S.lookup(S.fuzzy_paths(word, chunks(spark, sf_dir)), fulltext(spark, sf_dir), q)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


@query("f15_followup_queries", "WITH u AS (SELECT conv_id AS session_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE role = 'user') SELECT session_id, turn, md5(CASE WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) < 12 AND b IS NOT NULL THEN b || chr(10) || text ELSE text END) AS h FROM u")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.followup_queries(messages(spark, sf_dir)).select("session_id", "turn", F.md5("query").alias("h"))


# Evaluation: benchmark items are questions; their gold is the files of labelled good documents.


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select((F.col("doc_id") % 40).alias("item_id"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit("/f"), (F.col("doc_id") % 50).cast("string"), F.lit(".ts")).alias("p"))
    gold = good.groupBy("item_id").agg(F.sort_array(F.collect_set("p")).alias("gold"))
    q = table(spark, sf_dir, "benchmark").join(gold, "item_id", "left")
    return q.select(i.alias("question_id"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("repo"), F.when(i % 3 == 0, "flow").otherwise("locational").alias("type"), F.coalesce("gold", F.array().cast("array<string>")).alias("gold"), F.when(i % 4 == 0, "hand").otherwise("generated").alias("source"), (i % 5 == 0).alias("reviewed"))


_QUESTIONS = """go AS (SELECT DISTINCT doc_id % 40 AS question_id, 'src' || doc_id % 20 || '/f' || doc_id % 50 || '.ts' AS path FROM labels WHERE quality = 1),
qu AS (SELECT item_id AS question_id, 'src' || item_id % 20 AS repo, CASE WHEN item_id % 3 = 0 THEN 'flow' ELSE 'locational' END AS type, CASE WHEN item_id % 4 = 0 THEN 'hand' ELSE 'generated' END AS source, item_id % 5 = 0 AS reviewed FROM benchmark)"""
_RUN = f"""{_CTE}, {_QUESTIONS}, re AS (SELECT 'fulltext' AS retriever, query_id AS question_id, path, rank FROM ft JOIN c USING (chunk_id) WHERE rank <= 20 UNION ALL SELECT 'vector', query_id, path, rank FROM vs JOIN c USING (chunk_id) WHERE rank <= 20),
rb AS (SELECT retriever, question_id, path, min(rank) AS best FROM re GROUP BY ALL),
rf AS (SELECT * FROM (SELECT retriever, question_id, path, row_number() OVER (PARTITION BY retriever, question_id ORDER BY best, path) AS rank FROM rb) WHERE rank <= 10),
hi AS (SELECT retriever, question_id, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) AS f, sum(1 / log2(rank + 1)) AS g FROM rf JOIN go USING (question_id, path) GROUP BY ALL),
gn AS (SELECT question_id, count(*) AS n, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM go GROUP BY ALL),
sc AS (SELECT retriever, qu.question_id, type, repo, round(coalesce(h5 / n, 0), 9) AS recall_5, round(coalesce(h10 / n, 0), 9) AS recall_10, round(coalesce(1 / f, 0), 9) AS mrr, round(coalesce(g / ideal, 0), 9) AS ndcg_10
 FROM qu CROSS JOIN (SELECT DISTINCT retriever FROM rf) LEFT JOIN hi USING (retriever, question_id) LEFT JOIN gn ON gn.question_id = qu.question_id)"""


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.run_matrix({"fulltext": fulltext(spark, sf_dir), "vector": vector(spark, sf_dir)}, chunks(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = store(_run(spark, sf_dir), "run")
    return K.score_questions(ranked, questions(spark, sf_dir), ranked)


@query("k1_rank_files", f"WITH {_RUN} SELECT * FROM rf WHERE retriever = 'fulltext'")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = S.hydrate(fulltext(spark, sf_dir, 20), chunks(spark, sf_dir)).select(F.lit("fulltext").alias("retriever"), F.col("query_id").alias("question_id"), "path", "rank")
    return K.rank_files(got).filter("rank <= 10")


@query("k5_score_questions", f"WITH {_RUN} SELECT retriever, question_id, recall_5, recall_10, mrr, ndcg_10 FROM sc")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 5 and 10 (K2), reciprocal rank (K3) and nDCG at 10 (K4) in one aggregation."""
    return _scores(spark, sf_dir)


for _name, _metric in (("k2_recall", "recall_10"), ("k3_reciprocal_rank", "mrr"), ("k4_ndcg", "ndcg_10")):

    @query(_name, f"WITH {_RUN} SELECT retriever, question_id, {_metric} FROM sc")
    def _one(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        return _scores(spark, sf_dir).select("retriever", "question_id", metric)


@query("k6_summarize", f"WITH {_RUN} SELECT retriever, type, repo, count(*) AS n, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg_10), 6) AS ndcg_10, CASE WHEN grouping(type) = 1 AND grouping(repo) = 1 THEN 'overall' WHEN grouping(repo) = 1 THEN 'type' ELSE 'repo' END AS level FROM sc GROUP BY GROUPING SETS ((retriever), (retriever, type), (retriever, repo))")
def k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.summarize(_scores(spark, sf_dir), questions(spark, sf_dir))


@query("k7_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query("k8_run_matrix", f"WITH {_RUN} SELECT * FROM rf")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)


@query("k9_missing_gold", f"WITH {_CTE}, {_QUESTIONS} SELECT question_id, repo, path FROM go JOIN qu USING (question_id) ANTI JOIN c ON c.snapshot_id = repo AND c.path = go.path")
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.missing_gold(questions(spark, sf_dir), chunks(spark, sf_dir))


@query("k10_best_labels", f"WITH {_RUN}, a AS (SELECT question_id, retriever, recall_10, max(recall_10) OVER (PARTITION BY question_id) AS b FROM sc) SELECT question_id, retriever FROM a WHERE recall_10 >= b - 1e-9")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.best_labels(_scores(spark, sf_dir), "recall_10", "question_id")


@query("k11_latest_run", "SELECT event_type AS kind, arg_max(event_id, (ts, event_id)) AS run_id FROM events GROUP BY event_type")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.latest_run(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("run_id"), F.col("ts").alias("created_at")))


@query("k12_run_config", f"WITH {_QUESTIONS} SELECT repo, count(*) AS questions, count(*) FILTER (source = 'hand') AS hand, count(*) FILTER (source <> 'hand') AS \"generated\", count(*) FILTER (reviewed) AS reviewed FROM qu GROUP BY repo")
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.run_config(questions(spark, sf_dir))
