"""Queries of conversations (G), batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import chat as G
from lodestrata.plans.registry import query, table
from lodestrata.plans.search import messages
from lodestrata.sources.shared import new_path
from lodestrata.streaming import quota


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    from lodestrata.operators.search import top

    at = top(d.select(F.col("source").alias("query_id"), "doc_id", "n_chars", F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"), F.concat(F.lit("// "), "lang").alias("header")), 30, F.desc("n_chars"), F.col("doc_id"))
    return at.withColumns({"start_line": F.lit(1), "end_line": F.lit(9), "label": F.lit(None).cast("string")})


_PACK = """r AS (SELECT source AS query_id, doc_id, text AS content, '// ' || lang AS header, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
u AS (SELECT *, sum(least(length(content), 4000) + length(header)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM r WHERE rank <= 30),
p AS (SELECT query_id, doc_id, content, rank AS n FROM u WHERE used <= 28000 OR rank = 1)"""


@query("g1_pack_context", f"WITH {_PACK} SELECT query_id, doc_id, n FROM p")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pack_context(_ranked(spark, sf_dir)).select("query_id", "doc_id", "n")


@query("g2_render_sources", f"WITH {_PACK} SELECT query_id, md5(string_agg('[' || n || '] ' || query_id || '/d' || doc_id || '.md:1-9' || chr(10) || '```markdown' || chr(10) || CASE WHEN length(content) > 4000 THEN substr(content, 1, 4000) || chr(10) || '… (truncated)' ELSE content END || chr(10) || '```', chr(10) || chr(10) ORDER BY n)) AS h FROM p GROUP BY query_id")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.render_sources(G.pack_context(_ranked(spark, sf_dir))).select("query_id", F.md5("sources").alias("h"))


@query("g3_build_prompts", """WITH l AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations), s AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id AS session_id, 0 AS position, 'system' AS role, md5('Rules.') AS h FROM s UNION ALL SELECT conv_id, 100 - b, role, md5(text) FROM l WHERE b <= 6 UNION ALL SELECT conv_id, 1000, 'user', md5('Why?' || chr(10) || chr(10) || 'S' || conv_id) FROM s""")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    q = m.select("session_id").distinct().select("session_id", F.lit("Why?").alias("question"), F.concat(F.lit("S"), F.col("session_id").cast("string")).alias("sources"))
    return G.build_prompts(m, q, "Rules.").select("session_id", "position", "role", F.md5("content").alias("h"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir).filter("role = 'assistant'")
    c, t = F.col("session_id"), F.col("turn")
    text = F.concat(F.translate("content", "[]", "()"), F.lit(" ["), t.cast("string"), F.lit("] and ["), (c % 9).cast("string"), F.lit(", 99] ."), F.when(c % 2 == 0, " [98]").otherwise(""))
    return m.select("session_id", "turn", text.alias("content"), F.when(c % 5 == 0, 99).otherwise(6).alias("n_sources"), F.concat_ws("-", c.cast("string"), t.cast("string")).alias("answer_id"))


_ANSWERS = """a AS (SELECT conv_id, turn, conv_id || '-' || turn AS answer_id, translate(text, '[]', '()') AS lead, CASE WHEN conv_id % 5 = 0 THEN 99 ELSE 6 END AS n, conv_id % 9 AS m,
 list_distinct([turn, conv_id % 9, 99] || CASE WHEN conv_id % 2 = 0 THEN [98] ELSE [] END) AS ms FROM conversations WHERE role = 'assistant'),
k AS (SELECT *, list_filter(ms, lambda x: x >= 1 AND x <= n) AS good, list_filter(ms, lambda x: x < 1 OR x > n) AS bad,
 lead || ' ' || CASE WHEN turn BETWEEN 1 AND n THEN '[' || turn || ']' ELSE '' END || ' and ' || CASE WHEN m BETWEEN 1 AND n AND 99 <= n THEN '[' || m || ', 99]' WHEN m BETWEEN 1 AND n THEN '[' || m || ']' WHEN 99 <= n THEN '[99]' ELSE '' END || ' .'
 || CASE WHEN conv_id % 2 = 0 THEN ' ' || CASE WHEN 98 <= n THEN '[98]' ELSE '' END ELSE '' END AS t FROM a),
ck AS (SELECT *, CASE WHEN len(bad) > 0 THEN regexp_replace(regexp_replace(t, '[ \\t]+([.,;:!?])', '\\1', 'g'), '[ \\t]{2,}', ' ', 'g') ELSE t END AS cleaned FROM k)"""


@query("g4_check_citations", f"WITH {_ANSWERS} SELECT answer_id, len(good)::INT AS valid, len(bad)::INT AS invalid, list_sum(good)::BIGINT AS good_sum, cleaned, len(bad) > 0 AS flagged FROM ck")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = G.check_citations(_answers(spark, sf_dir))
    total = F.when(F.size("valid") > 0, F.aggregate("valid", F.lit(0).cast("long"), lambda s, x: s + x))
    return got.select("answer_id", F.size("valid").alias("valid"), F.size("invalid").alias("invalid"), total.alias("good_sum"), "cleaned", "flagged")


@query("g5_resolve_citations", f"WITH {_ANSWERS} SELECT answer_id, n, 'src/f' || n || '.ts' AS path FROM (SELECT answer_id, unnest(good) AS n FROM k) WHERE n <= 6")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    sources = a.select("answer_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))).alias("n")).withColumn("path", F.concat(F.lit("src/f"), F.col("n").cast("string"), F.lit(".ts")))
    return G.resolve_citations(G.check_citations(a), sources)


@query("g6_citation_validity", f"WITH {_ANSWERS} SELECT conv_id % 4 AS bucket, count(*) AS answers, sum(len(good))::BIGINT AS valid, sum(len(bad))::BIGINT AS invalid, round(1 - avg((len(bad) > 0)::INT), 6) AS clean_rate FROM k GROUP BY 1")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.citation_validity(G.check_citations(_answers(spark, sf_dir)).withColumn("bucket", F.col("session_id") % 4), "bucket")


@query("g7_recent_sessions", """WITH f AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id), s AS (SELECT conv_id, conv_id % 3 AS viewer, conv_id % 2 AS snapshot_id, max(turn) AS u FROM conversations GROUP BY conv_id)
SELECT viewer, snapshot_id, session_id, title, rank FROM (SELECT viewer, snapshot_id, s.conv_id AS session_id, substr(trim(regexp_replace(q, '\\s+', ' ', 'g')), 1, 80) AS title, row_number() OVER (PARTITION BY viewer, snapshot_id ORDER BY u DESC, s.conv_id) AS rank FROM s JOIN f ON s.conv_id = f.conv_id) WHERE rank <= 20""")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    s = m.groupBy("session_id").agg(F.max("turn").alias("updated_at")).select("session_id", (F.col("session_id") % 3).alias("viewer"), (F.col("session_id") % 2).alias("snapshot_id"), "updated_at")
    return G.recent_sessions(m, s)


@query("g8_transcript", "WITH p AS (SELECT conv_id AS session_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations) SELECT session_id, turn, position, CASE WHEN role = 'assistant' THEN 2 ELSE 0 END AS cited FROM p")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    c = m.filter("role = 'assistant'").select("session_id", "turn", F.explode(F.array(F.lit(2), F.lit(1))).alias("n")).withColumn("path", F.lit("a.ts"))
    return G.transcript(m, c).select("session_id", "turn", "position", F.size("citations").alias("cited"))


@query("g9_daily_quota", "SELECT event_id, n, n <= 3 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM events)")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.daily_quota(table(spark, sf_dir, "events"), "user_id", 3).select("event_id", "n", "allowed")


def _event_stream(spark: SparkSession, sf_dir: str, closing: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events")
    path = new_path(spark, "event-stream")
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    rows.repartitionByRange(8, "ts").write.parquet(path)
    if closing:  # one event long after all others, for the watermark to pass the last days
        end = rows.agg((F.max("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(None).cast(rows.schema["user_id"].dataType).alias("user_id"), F.lit("end").alias("event_type"))
        end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(path)


@query("g9_daily_quota_stream", "SELECT user_id, ts::DATE AS day, count(*) AS uses, greatest(count(*) - 3, 0) AS refused FROM events GROUP BY ALL")
def g9_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days: a closing event at the end of the stream lets the watermark pass the last of them."""
    out = quota.daily_uses(_event_stream(spark, sf_dir, closing=True), "user_id", 3)
    return quota.run_once(spark, out, new_path(spark, "quota"), new_path(spark, "quota-state")).filter("user_id is not null")


@query("g10_latest_progress", "SELECT user_id AS snapshot_id, arg_max(s, (ts, p, event_id)) AS status, arg_max(event_id, (ts, p, event_id)) AS progress FROM (SELECT *, (['QUEUED','FETCHING','PARSING','EMBEDDING','READY','FAILED'])[event_id % 6 + 1] AS s, event_id % 6 + 1 AS p FROM events) GROUP BY user_id")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = F.element_at(F.array(*map(F.lit, G.STATES)), (F.col("event_id") % 6 + 1).cast("int"))
    return G.latest_progress(e.select(F.col("user_id").alias("snapshot_id"), "ts", "event_id", state.alias("status"), F.col("event_id").alias("progress")))


@query("g10_latest_progress_stream", "SELECT user_id AS snapshot_id, arg_max(event_type, (ts, event_id)) AS status, max(event_id) FILTER (n = 1) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) GROUP BY user_id")
def g10_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _event_stream(spark, sf_dir).select(F.col("user_id").alias("snapshot_id"), "ts", "event_id", F.col("event_type").alias("status"))
    got = quota.run_once(spark, quota.latest_states(s), new_path(spark, "progress"), new_path(spark, "progress-state"), "update")
    at = table(spark, sf_dir, "events").select("event_id", "ts")
    return got.join(at, "event_id").groupBy("snapshot_id").agg(F.max_by(F.struct("status", "event_id"), F.struct("ts", "event_id")).alias("s")).select("snapshot_id", "s.status", "s.event_id")


@query("g11_attempt_outcomes", "SELECT event_id, n AS attempt, CASE WHEN event_id % 10 = 0 OR n >= 3 THEN 'FAILED' ELSE 'RETRYING' END AS outcome FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("snapshot_id"), "ts", (F.col("event_id") % 10 == 0).alias("permanent"))
    return G.attempt_outcomes(e).select("event_id", "attempt", "outcome")
