"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

For each language l the log posterior is the sum of the text's tempered log likelihood (naive Bayes over hashed byte
trigrams), log P(declared | l), log P(suffix | l) and log P(l | host). The latter three are smoothed counts over all
rows, grouped by what the text alone says; a host's prior is drawn to its suffix's, and that to the whole corpus's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import free, look_up, small, store

#: Labelled rows of each language that the text model is fitted on, about (those of least hash); all rows are scored and counted.
SAMPLE = 1000
#: Rows that declare a language, at least, for it to be a class; and bytes of the model, beyond which fitting fails.
LEAST_ROWS, MODEL_BYTES = 3, 256 << 20
#: Hash buckets of a trigram.
BUCKETS = 1 << 14
#: A text's trigrams count as so many independent ones at most.
EVIDENCE = 60
#: Pseudo-counts: of a host's prior, of its suffix's, and of the tables of declared languages and suffixes.
HOST, SUFFIX, TABLE = 20.0, 50.0, 1.0
#: A text of no language: its class's prior, and nats per trigram by which it is likelier than an even spread over the buckets.
NONE, NONE_PRIOR, NONE_GAIN = "und", 0.01, 0.0
#: Least posterior of an accepted language.
ACCEPT = 0.5


#: Printable ASCII that is no letter, and white space, reads as a space: numbers, addresses and keys say nothing of a language.
_READ = np.array([32 if b in range(9, 14) or 32 <= b < 127 and not chr(b).isalpha() else b for b in range(256)], dtype=np.uint8)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the text, lower-cased in A-Z, that hold at most one space."""
    b = _READ[np.frombuffer(text.encode("utf-8", "replace").lower(), dtype=np.uint8)]
    if len(b) < 3:
        return np.zeros(0, dtype=np.uint32)
    space = (b == 32).astype(np.uint8)
    kept = space[:-2] + space[1:-1] + space[2:] < 2
    b = b.astype(np.uint32)
    return (((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(18))[kept]


def code_of(declared: Column) -> Column:
    """The primary subtag of a language tag, of two or three letters and lower-cased; null for anything else."""
    return F.nullif(F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_][A-Za-z0-9_-]*)?\s*$", 1)), F.lit(""))


def address_suffix(text: Column) -> Column:
    """The last label of the first mail or web address in a text, lower-cased; null without one."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?:@|://)(?:[A-Za-z0-9_-]++\.)++([A-Za-z]{2,})", 1)), F.lit(""))


def fit(df: DataFrame, text: str, label: str, key: str, sample: int = SAMPLE, least: int = LEAST_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, table[bucket, language] of log likelihoods): the languages that least rows declare, each from about sample rows.

    Which languages there are is counted over all rows, so that a rare one is modelled however many rows the others have.
    """
    labelled = df.select(F.col(text).alias("t"), code_of(F.col(label)).alias("l"), F.xxhash64(F.lit("language"), F.col(key)).alias("h")).filter("t is not null and l is not null")
    counts = {r["l"]: r["count"] for r in labelled.groupBy("l").count().filter(F.col("count") >= least).collect()}  # codes of two or three letters
    languages = sorted(counts)
    if BUCKETS * len(languages) * 4 > MODEL_BYTES:
        raise ValueError(f"language_id: a model of {len(languages)} languages is larger than MODEL_BYTES")
    if not languages:
        return [], np.zeros((BUCKETS, 0), dtype="float32")
    upto = [(lang, min(2**63 - 1, int((min(1.0, sample / n) - 0.5) * 2**64))) for lang, n in counts.items()]
    rows = labelled.join(F.broadcast(df.sparkSession.createDataFrame(upto, "l string, upto long")), "l").filter("h <= upto").select("t", "l")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lang, texts in f.groupby("l")["t"]:
                n = sum((np.bincount(trigrams(t), minlength=BUCKETS) for t in texts), np.zeros(BUCKETS, dtype=np.int64))
                at = np.nonzero(n)[0]
                yield pd.DataFrame({"l": lang, "bucket": at, "n": n[at]})

    got = rows.mapInPandas(count, "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    table = np.full((BUCKETS, len(languages)), 0.5)
    for k, lang in enumerate(languages):
        of = got[got["l"] == lang]
        table[of["bucket"], k] += of["n"]
    return languages, np.log(table / table.sum(0)).astype("float32")


def text_scores(text: str | None, table: np.ndarray) -> list[float]:
    """Tempered log likelihood of each language, and last of no language; all zero for a text without trigrams."""
    at = trigrams(text) if text else np.zeros(0, dtype=np.uint32)
    if not len(at) or not table.shape[1]:
        return [0.0] * (table.shape[1] + 1)
    total = np.zeros(table.shape[1])
    for i in range(0, len(at), 1 << 16):
        total += table[at[i : i + (1 << 16)]].sum(0, dtype=np.float64)
    none = len(at) * (NONE_GAIN - math.log(BUCKETS))
    return [float(x) for x in np.append(total, none) * (min(len(at), EVIDENCE) / len(at))]


def _smoothed(counts: DataFrame, by: str, languages: list[str], above, weight: float) -> DataFrame:
    """(by, prior array) with weight pseudo-counts of above (an array column of counts' rows)."""
    n = F.array(*(F.sum(F.when(F.col("best") == lang, F.col("n")).otherwise(0)) for lang in languages))
    got = counts.groupBy(by).agg(n.alias("n"), F.sum("n").alias("all"), F.first(above).alias("above"))
    return got.select(by, F.zip_with("n", "above", lambda x, p: (x + weight * p) / (F.col("all") + weight)).alias("prior"))


def identify(df: DataFrame, id: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source", suffix: str | Column | None = None, sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """(id, declared, host, language, posterior, accepted), one row per row of df; language is "und" where no language fits.

    The classes are the languages that LEAST_ROWS rows declare. A declared language counts by its primary subtag.
    Evidence that is missing (a null or unmodelled declared language, no suffix, an empty or null text) says nothing;
    rows with a null host share one host. A text without trigrams rests on the other evidence alone, and if there is
    none on the priors. Ties go to the first language in byte order. With no labelled row at all nothing is accepted.
    accepted: the best class is a language and its posterior is at least accept.
    """
    languages, table = fit(df, text, declared, id, sample)
    classes = [*languages, NONE]
    box = df.sparkSession.sparkContext.broadcast(table)  # MODEL_BYTES at most

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([text_scores(t, box.value) for t in texts])

    best_of = lambda a: F.element_at(F.array(*map(F.lit, classes)), F.array_position(a, F.array_max(a)).cast("int"))
    has_suffix = suffix is not None
    suffixed = F.lower(F.col(suffix) if isinstance(suffix, str) else suffix) if has_suffix else F.lit("")
    at = df.select(F.col(id).alias("id"), F.col(declared).alias("said"), code_of(F.col(declared)).alias("declared"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.coalesce(suffixed, F.lit("")).alias("suffix"), score(F.col(text)).alias("scores"))
    at = store(at.withColumn("told", F.exists("scores", lambda x: x != 0)).withColumn("best", F.when(F.col("told"), best_of(F.col("scores")))), "language-scores")
    counts = store(at.filter("told").groupBy("host", "suffix", "declared", "best").agg(F.count("*").alias("n")), "language-counts")
    whole = {r["best"]: r["n"] for r in counts.groupBy("best").agg(F.sum("n").alias("n")).collect()}  # a row per class
    all_n = sum(whole.get(c, 0) for c in languages)
    base = [(1 - NONE_PRIOR) * (whole.get(c, 0) + TABLE) / (all_n + TABLE * max(1, len(languages))) for c in languages] + [NONE_PRIOR]
    flat = F.array(*map(F.lit, base))
    by_suffix = _smoothed(counts, "suffix", classes, flat, SUFFIX)
    by_host = store(_smoothed(counts.join(by_suffix, "suffix"), "host", classes, F.col("prior"), HOST), "host-priors")

    def likelihood(column: str) -> DataFrame:
        """(column, log P(column | class) array), even over the values for the class of no language."""
        got = counts.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.array(*(F.sum(F.when(F.col("best") == c, F.col("n")).otherwise(0)) for c in classes)).alias("n"))
        totals = got.agg(F.count("*").alias("values"), F.array(*(F.sum(F.col("n")[k]) for k in range(len(classes)))).alias("all")).first()
        values = max(1, totals["values"])
        sums = totals["all"] if totals["values"] else [0] * len(classes)
        logs = [F.log((F.col("n")[k] + TABLE) / F.lit(float(sums[k] + TABLE * values))) if c != NONE else F.lit(-math.log(values)) for k, c in enumerate(classes)]
        return store(got.select(F.col(column).alias(f"{column}_is"), F.array(*logs).alias(f"{column}_log")), f"given-{column}")

    zero = F.array(*(F.lit(0.0) for _ in classes))
    for column in ("declared", "suffix") if has_suffix else ("declared",):
        at = look_up(at, F.col(column), likelihood(column), f"{column}_is")
    prior = by_host.select(F.col("host").alias("host_is"), F.transform("prior", lambda p: F.log(p)).alias("host_log"))
    at = look_up(at, F.col("host"), prior, "host_is")
    terms = [F.col("scores"), F.coalesce("declared_log", zero), F.coalesce("host_log", F.transform(flat, lambda p: F.log(p)))] + ([F.coalesce("suffix_log", zero)] if has_suffix else [])
    post = terms[0]
    for t in terms[1:]:
        post = F.zip_with(post, t, lambda a, b: a + b)
    at = at.withColumn("post", post).withColumn("top", F.array_max("post"))
    at = at.withColumn("language", best_of(F.col("post"))).withColumn("posterior", 1 / F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    return at.select(F.col("id").alias(id), F.col("said").alias("declared"), "host", "language", F.round("posterior", 6).alias("posterior"), ((F.col("language") != NONE) & (F.col("posterior") >= accept)).alias("accepted"))


def accepted(df: DataFrame, id: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source", **more) -> DataFrame:
    """df without the rows that identify() rejects; columns as they are. Rows go by id, text, declared language and host together."""
    key = lambda d: F.struct(d[id].alias("id"), F.xxhash64(d[text], d[declared], d[host]).alias("h"))
    _id, _h = free(df, "_id"), free(df, "_h")
    keyed = df.select(key(df).alias("key"), F.col(text).alias("text"), F.col(declared).alias("lang"), F.col(host).alias("source"))
    bad = identify(keyed, "key", **more).filter("not accepted").select(F.col("key.id").alias(_id), F.col("key.h").alias(_h)).distinct()
    bad = small(store(bad, "rejected"))
    return df.join(bad, df[id].eqNullSafe(F.col(_id)) & (F.xxhash64(df[text], df[declared], df[host]) == F.col(_h)), "left_anti")
