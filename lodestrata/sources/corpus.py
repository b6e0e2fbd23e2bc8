"""Corpus sources, cleaning and sinks. Tables carry snapshot_id, the key that every operator groups by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.functions.text import directories, file_name, strings

#: What a path alone says about a file.
IGNORED_DIRECTORIES = "node_modules bower_components vendor dist build out coverage .next .nuxt .svelte-kit .output .vercel .turbo .cache .yarn .git __snapshots__".split()
LOCKFILES = "package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml bun.lockb bun.lock".split()
CODE_EXTENSIONS = {".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript"}
#: Default limits of a file and of a snapshot.
MAX_FILE_BYTES = 200 * 1024
LIMITS = {"code_files": 2000, "total_bytes": 30 * 1024 * 1024, "unpacked": 20, "chunks": 8000}
GENERATED = r"(?i)@generated|do not edit|auto-?generated"


#: Files of more bytes are read by lines, which tasks share out; what a text reader would unpack stays whole.
WHOLE_BYTES = 64 << 20
PACKED = "gz gzip bz2 deflate lz4 snappy zst zstd".split()


def read_corpus(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    """(snapshot_id, path, content binary) of all files under path, by Spark's binary reader, which passes over empty ones."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.lit(snapshot_id).alias("snapshot_id"), "path", "content")


def corpus_pieces(spark: SparkSession, path: str, snapshot_id: str, most: int = WHOLE_BYTES) -> DataFrame:
    """(snapshot_id, path, size, content binary, ends) of all files under path: one row of a file of up to most bytes, as
    read_corpus has it, and of a larger one a row for each line, in no order, so that no task holds or reads all of it.

    size: the file's bytes; ends: the bytes of the line break after the row, which content leaves out. The reader doesn't tell whether
    the last line has one, so ends counts one there too. Larger files that are packed stay whole.
    """
    at = spark.read.option("recursiveFileLookup", "true")
    packed, name = F.col("path").rlike(rf"\.({'|'.join(PACKED)})$"), F.lit(snapshot_id).alias("snapshot_id")
    # the reader passes over files by their length and a pattern of their names, but by no other condition
    over = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(PACKED)}}}").format("binaryFile").load(path)
    some = [at.format("binaryFile").load(path).filter(F.col("length") <= most), over.filter(F.col("length") > most)]
    # the address of a file, written as the binary reader writes paths
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^([A-Za-z0-9+.-]+:)//(?=/)", "$1")
    lines = at.format("text").option("lineSep", "\n").load(path).select(plain.alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("content"))
    lines = lines.filter((F.col("size") > most) & ~packed).select(name, "path", "size", "content", F.lit(1).alias("ends"))
    return reduce(DataFrame.union, (w.select(name, "path", F.col("length").alias("size"), "content", F.lit(0).alias("ends")) for w in some), lines)


def read_sizes(pieces: DataFrame) -> DataFrame:
    """(snapshot_id, path, n_bytes): the bytes read of each file of corpus_pieces. A last line may end without a break; a file
    whose pieces say otherwise than its size fails."""
    read = pieces.groupBy("snapshot_id", "path").agg(F.max("size").alias("size"), F.sum(F.octet_length("content").cast("long") + F.col("ends")).alias("n"), F.max("ends").alias("ends"))
    over = F.col("n") - F.col("size")
    n = F.when((over == 0) | ((over == 1) & (F.col("ends") == 1)), F.col("size")).otherwise(F.raise_error(F.concat(F.lit("not read whole: "), F.col("path"))).cast("long"))
    return read.select("snapshot_id", "path", n.alias("n_bytes"))


def safe_path(path: Column, strip_top: bool = False) -> Column:
    """The path without empty and . segments (and its first segment); null if it could leave the root."""
    p = F.regexp_replace(path, r"^[^/]+/", "") if strip_top else path
    parts = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    bad = (p == "") | p.contains("\0") | p.contains("\\") | p.startswith("/") | p.rlike("(?i)^[a-z]:") | (F.size(parts) == 0) | F.array_contains(parts, "..")
    return F.when(~bad, F.array_join(parts, "/"))


def normalize_paths(df: DataFrame, strip_top: bool = False) -> DataFrame:
    """df with safe paths; skip is unsafe-path where there is none, and the path is then as it was."""
    safe = safe_path(F.col("path"), strip_top)
    return df.withColumn("skip", F.when(safe.isNull(), "unsafe-path")).withColumn("path", F.coalesce(safe, "path"))


def path_class(path: Column) -> Column:
    """struct(kind, language, skip): kind and language, or why the file is skipped. The first rule that holds counts."""
    name = F.lower(file_name(path))
    ext = F.regexp_extract(name, r"(\.[a-z0-9]+)$", 1)
    is_a = lambda kind, language: F.struct(F.lit(kind).alias("kind"), (F.lit(language) if isinstance(language, str) else language).alias("language"), F.lit(None).cast("string").alias("skip"))
    skip = lambda why: F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("language"), F.lit(why).alias("skip"))
    code = F.element_at(F.create_map(*(F.lit(x) for kv in CODE_EXTENSIONS.items() for x in kv)), ext)
    return (
        F.when(F.arrays_overlap(directories(path), strings(IGNORED_DIRECTORIES)), skip("ignored-directory"))
        .when(name.isin(LOCKFILES), skip("lockfile"))
        .when(name.endswith(".map"), skip("source-map"))
        .when(name.rlike(r"\.min\.[cm]?js$|[.-]bundle\.[cm]?js$"), skip("minified"))
        .when(code.isNotNull(), is_a("CODE", code))
        .when(ext.isin(".md", ".mdx"), is_a("DOC", "markdown"))
        .when((name == "readme") | name.startswith("readme."), is_a("DOC", "text"))
        .when((F.substring_index(path, "/", 1) == "docs") & ext.isin(".txt", ".rst"), is_a("DOC", "text"))
        .when((name == "package.json") | name.rlike(r"^[tj]sconfig(\..+)?\.json$"), is_a("CONFIG", "json"))
        .when((name == "dockerfile") | name.endswith(".dockerfile"), is_a("CONFIG", "dockerfile"))
        .when(name.rlike(r"^(docker-)?compose(\..+)?\.ya?ml$"), is_a("CONFIG", "yaml"))
        .when(ext == ".prisma", is_a("CONFIG", "prisma"))
        .when(name.isin(".env.example", ".env.sample"), is_a("CONFIG", "text"))
        .otherwise(skip("unsupported-type"))
    )


def classify_paths(df: DataFrame) -> DataFrame:
    return df.withColumn("_c", path_class(F.col("path"))).withColumns({k: F.col(f"_c.{k}") for k in ("kind", "language", "skip")}).drop("_c")


def content_problem(content: Column, kind: Column) -> Column:
    """binary, generated, minified or null."""
    head = F.array_join(F.slice(F.split(F.substring(content, 1, 1000), "\n"), 1, 5), "\n")
    lines = F.split(content, "\n")
    long = (F.array_max(F.transform(lines, lambda x: F.length(x))) > 5000) | (F.length(content) / F.size(lines) > 200)
    return F.when(content.contains("\0"), "binary").when(head.rlike(GENERATED), "generated").when((kind == "CODE") & (F.length(content) > 2000) & long, "minified")


def inspect_content(df: DataFrame) -> DataFrame:
    return df.withColumn("skip", F.coalesce("skip", content_problem(F.col("content"), F.col("kind"))))


def filter_size(df: DataFrame, most: int = MAX_FILE_BYTES) -> DataFrame:
    """skip is too-large over the limit; this comes before content checks."""
    return df.withColumn("skip", F.coalesce("skip", F.when(F.octet_length("content") > most, "too-large")))


def clean_corpus(df: DataFrame, most: int = MAX_FILE_BYTES) -> DataFrame:
    """Paths, classes, sizes and contents checked in order; skip says why a file is left out, or is null."""
    at = normalize_paths(df)
    unsafe = F.col("skip")
    at = at.withColumn("_unsafe", unsafe)
    at = classify_paths(at).withColumn("skip", F.coalesce("_unsafe", "skip")).drop("_unsafe")
    return inspect_content(filter_size(at, most))


def file_metadata(df: DataFrame) -> DataFrame:
    """df with size_bytes, line_count (0 if empty, else the number of \\n-separated parts) and content_hash."""
    return df.withColumns({"size_bytes": F.octet_length("content"), "line_count": F.when(F.col("content") == "", 0).otherwise(F.size(F.split("content", "\n"))), "content_hash": F.sha2("content", 256)})


def skip_audit(df: DataFrame, by: str = "snapshot_id") -> DataFrame:
    return df.filter("skip is not null").groupBy(by, "skip").agg(F.count("*").alias("n"))


def check_limits(df: DataFrame, limits: dict[str, int] | None = None, by: str = "snapshot_id", chunks: DataFrame | None = None) -> DataFrame:
    """(snapshot, code_files, total_bytes, unpacked_bytes, chunks, problem): code files are those that passed the content checks.

    unpacked_bytes counts all entries, and may be limits["unpacked"] times the limit of total bytes; chunks: the
    snapshot's chunk table, where it has been made (null before).
    """
    limits = LIMITS | (limits or {})
    kept = F.col("skip").isNull()
    bytes_ = F.octet_length("content").cast("long")
    at = df.groupBy(by).agg(F.count_if(kept & (F.col("kind") == "CODE")).alias("code_files"), F.coalesce(F.sum(F.when(kept, bytes_)), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(bytes_), F.lit(0)).alias("unpacked_bytes"))
    none = F.lit(None).cast("long")
    at = at.withColumn("chunks", none) if chunks is None else at.join(chunks.groupBy(by).agg(F.count("*").alias("chunks")), by, "left").fillna(0, ["chunks"])
    problem = F.when(F.col("unpacked_bytes") > limits["unpacked"] * limits["total_bytes"], "unpacks-too-large").when(F.col("code_files") > limits["code_files"], "too-many-files")
    return at.withColumn("problem", problem.when(F.col("total_bytes") > limits["total_bytes"], "too-large").when(F.col("chunks") > limits["chunks"], "too-many-chunks"))


def with_id(df: DataFrame, name: str, *key: str) -> DataFrame:
    """An id from the natural key, the same in every attempt of a task."""
    return df.withColumn(name, F.sha2(F.concat_ws("\u0001", *(F.col(k).cast("string") for k in key)), 256))


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace the snapshots that df holds, and no others; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def append_new(df: DataFrame, existing: DataFrame, *key: str) -> DataFrame:
    """Rows of df, one for each key, whose key is not in existing."""
    return df.dropDuplicates(list(key)).join(existing.select(*key).distinct(), list(key), "left_anti")


def attach_embeddings(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks with vectors' embedding where there is one, else their own."""
    new = vectors.select(key, F.col("embedding").alias("_new"))
    return chunks.join(new, key, "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")


def explode_lines(files: DataFrame, *keep: str, content: str = "content") -> DataFrame:
    """(keep..., line_no from 1, line): a trailing newline gives a last empty line."""
    return files.select(*keep, F.posexplode(F.split(content, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


QUESTION = "id string, repo string, type string, question string, gold array<string>, source string, reviewed boolean, note string"


def read_questions(spark: SparkSession, path: str, repos: list[str]) -> DataFrame:
    """Questions of JSON-lines files with problem: why a line is refused, or null. line counts from 1 in each file, blank lines too.

    A question set is a file that people write, so each file is read whole for its lines to be counted.
    """
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "value")).filter(F.trim("value") != "")
    return check_questions(whole.select((F.col("n") + 1).alias("line"), F.from_json("value", QUESTION).alias("q")).select("line", "q.*"), repos)


def check_questions(questions: DataFrame, repos: list[str]) -> DataFrame:
    twice = F.count("*").over(W.partitionBy("id")) > 1
    problem = (
        F.when(F.col("id").isNull() | ~F.col("id").rlike(r"^[a-z0-9][a-z0-9-]*$"), "bad id")
        .when(~F.col("repo").isin(repos), "unknown repository")
        .when(twice, "duplicate id")
        .when(F.coalesce(F.size("gold"), F.lit(0)) < 1, "no gold")
        .when(F.size(F.array_distinct("gold")) < F.size("gold"), "repeated gold")
        .when(F.coalesce(F.length("question"), F.lit(0)) < 8, "short question")
    )
    return questions.withColumn("problem", problem)


def dataset_version(version: Column, text: Column) -> Column:
    return F.concat_ws("-", version, F.substring(F.sha2(text, 256), 1, 8))
