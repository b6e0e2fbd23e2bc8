"""Corpus pipeline over documents: five stages, each written as Parquet and read again by the next.

A stage works on all that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe_codec, decontaminate, language_id, line_dedup, near_copies
from lodestrata.llm.common import store, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, or of none with enough probability, go."""
    return language_id.accepted(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a large share of a source's documents hold go; documents stay, and n_chars follows the text."""
    return line_dedup.without_boilerplate(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of near copies (5-word Jaccard of 0.8 or more) the document with the least id stays; null ids stay."""
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text that they decode to."""
    out = bpe_codec.code_digests(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_codec", encode_and_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", in_turn=True)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs


#: SQL has neither the components of the near-duplicate stage nor the tokenizer; the tests compare run() with brute force.
ORACLE_SQL = None

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
SQL: dict[str, str] = {}
