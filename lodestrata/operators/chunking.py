"""Chunking: spans of symbols, islands between them, sections of documents, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.functions.text import is_boring

MAX_LINES, EMBED_CHARS = 150, 20_000
KEY = ("snapshot_id", "path")


def symbol_spans(symbols: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """One span per top-level symbol; a class of more than max_lines with methods gives its head and one per method."""
    top = symbols.filter("parent_id is null")
    methods = symbols.filter("parent_id is not null").groupBy(F.col("parent_id").alias("owner")).agg(F.min("start_line").alias("first"))
    at = top.join(methods, F.col("symbol_id") == F.col("owner"), "left").withColumn("cut", (F.col("kind") == "class") & (F.col("end_line") - F.col("start_line") + 1 > max_lines) & F.col("first").isNotNull())
    heads = at.select(*KEY, "symbol_id", "start_line", F.when(F.col("cut"), F.col("first") - 1).otherwise(F.col("end_line")).alias("end_line")).filter("end_line >= start_line")
    parts = symbols.join(at.filter("cut").select(F.col("symbol_id").alias("parent_id")), "parent_id", "left_semi").select(*KEY, "symbol_id", "start_line", "end_line")
    return heads.union(parts)


def module_spans(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(key, start_line, end_line) of runs of lines that no top-level symbol covers, without boring ends; two meaningful lines or more."""
    top = symbols.filter("parent_id is null").select(*KEY, F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    # lines covered as a running sum of starts and ends
    marks = top.select(*KEY, F.col("s").alias("line_no"), F.lit(1).alias("d")).union(top.select(*KEY, F.col("e") + 1, F.lit(-1))).groupBy(*KEY, "line_no").agg(F.sum("d").alias("d"))
    w = W.partitionBy(*KEY).orderBy("line_no")
    at = lines.join(marks, [*KEY, "line_no"], "left").withColumn("depth", F.sum(F.coalesce("d", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    free = at.filter("depth = 0").withColumn("island", F.col("line_no") - F.row_number().over(w))
    good = F.when(~is_boring(F.col("line")), F.col("line_no"))
    return free.groupBy(*KEY, "island").agg(F.min(good).alias("start_line"), F.max(good).alias("end_line"), F.count(good).alias("meaningful")).filter("meaningful >= 2").drop("island")


def doc_sections(lines: DataFrame) -> DataFrame:
    """(key, section, label, start_line, end_line): split at headings outside fences; sections of headings only go."""
    w = W.partitionBy(*KEY).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    at = lines.withColumn("inside", F.sum(fence.cast("int")).over(w) % 2 == 1)
    heading = F.when(~F.col("inside"), F.nullif(F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*#*\s*$", 1), F.lit("")))
    at = at.withColumn("heading", heading).withColumn("section", F.sum((F.col("heading").isNotNull() & (F.col("line_no") > 1)).cast("int")).over(w))
    body = (F.trim("line") != "") & ~F.col("line").rlike(r"^#{1,6}\s")
    got = at.groupBy(*KEY, "section").agg(F.min_by("heading", "line_no").alias("label"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.max(body).alias("body"))
    return got.filter("body").drop("body")


def split_spans(spans: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """Spans of more than max_lines in parts, part_label " [part i/n]"; others as they are with a null one."""
    n = F.ceil((F.col("end_line") - F.col("start_line") + 1) / max_lines).cast("int")
    at = spans.withColumn("_n", F.greatest(n, F.lit(1))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.col("start_line") + F.col("_i") * max_lines
    label = F.when(F.col("_n") > 1, F.concat(F.lit(" [part "), (F.col("_i") + 1).cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit("]")))
    at = at.withColumn("part_label", label).withColumn("_s", start).withColumn("end_line", F.least("end_line", F.col("_s") + max_lines - 1)).withColumn("start_line", F.col("_s"))
    return at.drop("_n", "_i", "_s")


def render_chunks(spans: DataFrame, lines: DataFrame, imports: DataFrame) -> DataFrame:
    """spans (key, span_id, label, start_line, end_line) with content and a header of file, scope and the imports used."""
    at = spans.join(lines, list(KEY)).filter(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    text = at.groupBy(*KEY, "span_id", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    words = text.select(*KEY, "span_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1)))).alias("local_name"))
    used = words.join(imports.select(*KEY, "local_name", "specifier"), [*KEY, "local_name"]).groupBy(*KEY, "span_id").agg(F.array_join(F.array_sort(F.collect_set("specifier")), ", ").alias("used"))
    header = F.concat_ws("\n", F.concat(F.lit("// file: "), "path"), F.concat(F.lit("// scope: "), F.coalesce("label", F.lit("module"))), F.concat(F.lit("// uses: "), "used"))
    return text.join(used, [*KEY, "span_id"], "left").withColumn("header", header).drop("used")


def embedding_text(path: Column, label: Column, header: Column, content: Column) -> Column:
    title = F.concat(path, F.coalesce(F.concat(F.lit(" · "), label), F.lit("")))
    return F.substring(F.concat(F.lit("title: "), title, F.lit(" | text: "), header, F.lit("\n"), content), 1, EMBED_CHARS)


def embedding_query(text: Column) -> Column:
    return F.concat(F.lit("task: code retrieval | query: "), text)
