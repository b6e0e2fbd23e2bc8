"""Conversations: context packing, prompts, citations, transcripts, quotas and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.functions.text import check_citations as citation_check

#: Characters of a source, and of all sources, in a prompt.
SOURCE_CHARS, CONTEXT_CHARS = 4000, 28000
HISTORY, RECENT, TITLE_CHARS, ATTEMPTS = 6, 20, 80, 3
#: Fence names by file extension.
FENCES = {"ts": "ts", "tsx": "tsx", "js": "js", "jsx": "jsx", "mjs": "js", "cjs": "js", "md": "markdown", "mdx": "markdown"}
#: Order of a snapshot's states.
STATES = ["QUEUED", "FETCHING", "PARSING", "EMBEDDING", "READY", "FAILED"]


def pack_context(ranked: DataFrame, by: str = "query_id") -> DataFrame:
    """Ranked sources while their cut lengths and headers fit; the first always stays, the first overflow ends it."""
    w = W.partitionBy(by).orderBy("rank")
    size = F.least(F.length("content"), F.lit(SOURCE_CHARS)) + F.length("header")
    at = ranked.withColumn("used", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    return at.filter((F.col("used") <= CONTEXT_CHARS) | (F.col("n") == 1)).drop("used")


def rendered_source(n: Column) -> Column:
    ext = F.substring_index("path", ".", -1)
    fence = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FENCES.items() for x in kv)), ext), F.lit(""))
    content = F.when(F.length("content") > SOURCE_CHARS, F.concat(F.substring("content", 1, SOURCE_CHARS), F.lit("\n… (truncated)"))).otherwise(F.col("content"))
    title = F.concat(F.lit("["), n.cast("string"), F.lit("] "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.coalesce(F.concat(F.lit(" ("), "label", F.lit(")")), F.lit("")))
    return F.concat(title, F.lit("\n```"), fence, F.lit("\n"), content, F.lit("\n```"))


def render_sources(packed: DataFrame, by: str = "query_id") -> DataFrame:
    """(by, sources): the packed sources, numbered from 1, as one text."""
    each = packed.select(by, "n", rendered_source(F.col("n")).alias("s"))
    return each.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "\n\n").alias("sources"))


def build_prompts(messages: DataFrame, questions: DataFrame, system: str) -> DataFrame:
    """(session_id, position, role, content): the system's rules, the last messages in order, the question with its sources."""
    last = messages.withColumn("back", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn")))).filter(F.col("back") <= HISTORY)
    asked = questions.select("session_id", F.lit(1000).alias("position"), F.lit("user").alias("role"), F.concat_ws("\n\n", "question", "sources").alias("content"))
    rules = questions.select("session_id", F.lit(0).alias("position"), F.lit("system").alias("role"), F.lit(system).alias("content"))
    return rules.union(last.select("session_id", (100 - F.col("back")).alias("position"), "role", "content")).union(asked)


def check_citations(answers: DataFrame, text: str = "content", sources: str = "n_sources") -> DataFrame:
    return answers.withColumn("_c", citation_check(F.col(text), F.col(sources))).select("*", "_c.*").drop("_c")


def resolve_citations(checked: DataFrame, sources: DataFrame, by: str = "answer_id") -> DataFrame:
    """Each valid marker with the source of that number."""
    return checked.select(by, F.explode("valid").alias("n")).join(sources, [by, "n"])


def citation_validity(checked: DataFrame, by: str) -> DataFrame:
    return checked.groupBy(by).agg(F.count("*").alias("answers"), F.sum(F.size("valid")).alias("valid"), F.sum(F.size("invalid")).alias("invalid"), F.round(1 - F.avg(F.col("flagged").cast("double")), 6).alias("clean_rate"))


def recent_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(viewer, snapshot_id, session_id, title, rank): a viewer's RECENT last sessions of a snapshot by their last message."""
    first = messages.filter("role = 'user'").groupBy("session_id").agg(F.min_by("content", "turn").alias("q"))
    title = F.substring(F.trim(F.regexp_replace("q", r"\s+", " ")), 1, TITLE_CHARS)
    at = sessions.join(first, "session_id").withColumn("title", title)
    return at.withColumn("rank", F.row_number().over(W.partitionBy("viewer", "snapshot_id").orderBy(F.desc("updated_at"), "session_id"))).filter(F.col("rank") <= RECENT).select("viewer", "snapshot_id", "session_id", "title", "rank")


def transcript(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """Messages in order, each with its citations by marker."""
    cited = citations.groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(F.struct("n", "path"))).alias("citations"))
    none = F.array().cast(cited.schema["citations"].dataType)
    at = messages.join(cited, ["session_id", "turn"], "left").withColumn("citations", F.coalesce("citations", none))
    return at.withColumn("position", F.row_number().over(W.partitionBy("session_id").orderBy("turn")))


def daily_quota(events: DataFrame, key: str, limit: int, at: str = "ts", id: str = "event_id") -> DataFrame:
    """events with n, the use of the key in its UTC day, and allowed: n <= limit."""
    n = F.row_number().over(W.partitionBy(key, F.to_date(at)).orderBy(at, id))
    return events.withColumn("n", n).withColumn("allowed", F.col("n") <= limit)


def latest_progress(events: DataFrame) -> DataFrame:
    """(snapshot_id, status, progress): the latest by time and then order of states."""
    order = F.struct("ts", F.array_position(F.array(*map(F.lit, STATES)), F.col("status")), "event_id")
    return events.groupBy("snapshot_id").agg(F.max_by(F.struct("status", "progress"), order).alias("s")).select("snapshot_id", "s.status", "s.progress")


def attempt_outcomes(failures: DataFrame) -> DataFrame:
    """failures with attempt and outcome: permanent errors fail, transient ones retry until the last of ATTEMPTS."""
    n = F.row_number().over(W.partitionBy("snapshot_id").orderBy("ts", "event_id"))
    return failures.withColumn("attempt", n).withColumn("outcome", F.when(F.col("permanent") | (F.col("attempt") >= ATTEMPTS), "FAILED").otherwise("RETRYING"))
