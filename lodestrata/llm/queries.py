"""The queries of the training-data operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe_codec, decontaminate, fertility, grid_join, importance, language_id, license_scan, line_dedup, pii, simhash, token_counts, warc, whitening
from lodestrata.llm.common import table


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.linked_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, words=3)


def op5_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10).drop("items")


def op6_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents")).drop("found")


def op7_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.without_boilerplate(table(spark, sf_dir, "documents", in_turn=True))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), suffix=language_id.address_suffix(F.col("text")))


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 with all its evidence: declared markup language, address suffix and host of the pages."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.btrim(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")).alias("text"),
        F.lower(F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]{2})", 1), F.lit(""))).alias("lang"),
        F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("host"),
    )
    pages = pages.withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))
    return language_id.identify(pages, id="page_id", host="host", suffix="suffix")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.code_digests(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = [public_tokenizers.path(name) for name in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")]
    return fertility.judge(table(spark, sf_dir, "documents"), vocabularies, public_tokenizers.PATTERN)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc_chunks, op2_grid_order_join, op3_token_counts, op4_covering_simhash, op5_prefix_decontamination, op6_weak_pii, op7_site_lines, op8_language_id, op9_bpe_codec, op10_license_scan, op11_lanczos_whitening, op12_fertility, op13_importance, pages_language)
}

_WORDS = r"""regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_BASE32 = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * (i // 4) + 1}, 5))::BIGINT >> {15 - 5 * (i % 4)}) & 31) + 1)::INT, 1)" for i in range(32))

OP1_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS f FROM p GROUP BY h)
SELECT p.page_id, payload_bytes, {_BASE32.replace("(h,", "(p.h,")} AS payload_digest,
       CASE WHEN page_id < f OR page_id IS NULL AND f IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < f OR page_id IS NULL THEN f END AS refers_to
FROM p JOIN m ON p.h = m.h
"""

_LEADS = ", ".join(f"lead(x, {k}) OVER o" for k in range(1, 10))

OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(text="text")} AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS s FROM d),
dl AS (SELECT doc_id, s, [x, {_LEADS}] AS xs FROM dp WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
dx AS (SELECT doc_id, n, s, array_to_string(xs[1:n], ' ') AS x FROM dl, lens WHERE xs[n] IS NOT NULL),
hit AS (SELECT doc_id, item_id, dx.n AS n, s FROM dx JOIN win ON dx.x = win.x AND dx.n = win.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
t AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
l AS (SELECT DISTINCT r, source, trim(x, chr(32) || chr(9) || chr(13)) AS x FROM (SELECT r, source, unnest(ls) AS x FROM p)),
c AS (SELECT l.source, x FROM l JOIN t ON l.source = t.source WHERE x <> '' GROUP BY l.source, x, pages
      HAVING count(*) >= {line_dedup.PAGES} AND count(*)::DOUBLE / pages > {line_dedup.RATIO}::DOUBLE),
b AS (SELECT source, list(x) AS xs FROM c GROUP BY source),
k AS (SELECT doc_id, ls, list_filter(ls, lambda y: NOT list_contains(coalesce(xs, []), trim(y, chr(32) || chr(9) || chr(13)))) AS kept FROM p LEFT JOIN b ON p.source = b.source)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
"""


def _templates_sql() -> str:
    rows = []
    for name, text in license_scan.TEMPLATES.items():
        of = license_scan.bigrams_of_template(text)
        pairs = ", ".join(f"'{a} {b}'" for a, b in of)
        rows.append(f"('{name}', {len(license_scan.words_of_template(text)) - 1}, {license_scan.needed(len(of))}, [{pairs}])")
    return ", ".join(rows)


OP10_SQL = f"""
WITH t(license, length, least, tb) AS (VALUES {_templates_sql()}),
tx AS (SELECT license, length, least, unnest(tb) AS x FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text="text")} AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w))) AS s, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM d WHERE len(w) > 1),
h AS (SELECT r, s, license, length, least, x FROM p JOIN tx USING (x)),
c AS (SELECT r, license, length FROM h GROUP BY ALL HAVING count(DISTINCT x) >= any_value(least)),
u AS (SELECT h.r, h.license, list_distinct(list_transform(range(h.s, least(h.s + h.length, len(w))), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM h JOIN c ON c.r = h.r AND c.license = h.license JOIN d ON d.r = h.r),
m AS (SELECT r, license, max(2.0 * len(list_intersect(b, tb)) / (len(b) + len(tb))) AS dice FROM u JOIN t USING (license) GROUP BY ALL),
k AS (SELECT * FROM m WHERE dice >= {license_scan.DICE}),
a AS (SELECT r, count(*) AS n, max(dice) AS best, string_agg(license, ',' ORDER BY license) AS licenses FROM k GROUP BY r),
f AS (SELECT k.r, min(license) AS best_license FROM k JOIN a ON k.r = a.r AND k.dice = a.best GROUP BY k.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, best_license, round(best, 6)::DOUBLE AS best_dice
FROM d LEFT JOIN a ON d.r = a.r LEFT JOIN f ON d.r = f.r
"""

SQL: dict[str, str] = {"op1_warc_chunks": OP1_SQL, "op5_prefix_decontamination": OP5_SQL, "op7_site_lines": OP7_SQL, "op10_license_scan": OP10_SQL}
