"""Operator 4 where copies are told by their texts: one of each group of near copies by the Jaccard similarity of word shingles.

Covering tables of the shingles' SimHash bring together every pair within their radius, and an exact comparison of the
shingles confirms it. At a similarity of 0.8 fingerprints differ in ten bits or so, beyond any radius that covering
tables can have; so what they leave is completed by a prefix-filtered set join, in which pairs that confirmed links
connect already are not compared again.

All shingles have one order, rarest first as far as a sample knows. Two texts at or above the similarity share at least
one of the first n - ceil(n x similarity) + 1 of each one's n shingles, whatever the order is; only those are written and
joined. A pair that meets is verified on all its shingles, unless verified links connect it already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.llm import simhash
from lodestrata.llm.common import free, small, store
from lodestrata.llm.components import components

#: Words of a shingle, and the least Jaccard similarity of near copies as a fraction.
WORDS, SIMILARITY = 5, (4, 5)
#: Texts whose shingles a worker hands on together.
STEP = 500
#: Classes of hashes that bound what two sets share, a power of two.
SPREAD = 256
#: Rows whose shingles are counted for the order, texts that make a shingle common, and common shingles kept, at most.
SAMPLE, COMMON, KEPT = 5_000, 2, 200_000
#: Rounds in which a bucket's members meet one of them, before all of them meet.
ROUNDS = 2


def hashes_of(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included; all words of a shorter text are one, a text without words has none."""
    w = text.encode("utf-8", "replace").lower().split() if text else []
    if not w:
        return np.zeros(0, dtype="<u8")
    parts = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype="<u8")


def shingles_of(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different word shingles."""
    return np.unique(hashes_of(text, words).view("<i8"))


def _few(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The batches in pieces of STEP: what is made of them is many times the texts."""
    for texts in batches:
        for i in range(0, len(texts), STEP):
            yield texts.iloc[i : i + STEP]


def _spread(h: np.ndarray) -> bytes:
    n = np.bincount(h & (SPREAD - 1), minlength=SPREAD)
    return (n if n.max() < 65535 else np.full(SPREAD, 65535)).astype("<u2").tobytes()


def _may_share(similarity: tuple[int, int]):
    """Two sets share at most the sum of the lesser counts of each class; whether that is enough."""
    p, q = similarity

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        most = [int(np.minimum(np.frombuffer(x, dtype="<u2"), np.frombuffer(y, dtype="<u2")).sum(dtype=np.int64)) for x, y in zip(a, b, strict=True)]
        full = [x[:2] == b"\xff\xff" or y[:2] == b"\xff\xff" for x, y in zip(a, b, strict=True)]
        return (pd.Series(most, dtype="int64") * (p + q) >= (na.astype("int64") + nb.astype("int64")) * p) | pd.Series(full, dtype=bool)

    return may


def _digest(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), 7) - (1 << 63)


def _shingles(text: Column, words: int) -> Column:
    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in _few(batches):
            yield pd.Series([shingles_of(t, words) for t in texts], dtype=object)

    return hashes(text)


def _common(df: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles and their counts, of a sample by hash. They set the order only, never the result."""
    share = min(1.0, SAMPLE / max(1, df.count()))
    some = df.filter(F.xxhash64(F.lit("order"), F.col(text)) <= min(2**63 - 1, int((share - 0.5) * 2**64))).select(F.explode(_shingles(F.col(text), words)).alias("h"))
    n = some.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(KEPT).toPandas().sort_values("h")
    return n["h"].to_numpy(dtype=np.int64), n["n"].to_numpy(dtype=np.int64)


def _named(text: Column, words: int) -> Column:
    """struct(digest, s) of all shingles."""

    @F.pandas_udf("digest long, s array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _few(batches):
            s = [shingles_of(t, words) for t in texts]
            yield pd.DataFrame({"digest": [_digest(h) for h in s], "s": pd.Series(s, dtype=object)})

    return sets(text)


def _prefixes(text: Column, words: int, similarity: tuple[int, int], box) -> Column:
    """struct(digest, fp, size, prefix, spread): of all shingles, their SimHash and number, the first ones in the order, and
    how many fall into each of SPREAD classes of their hashes (two bytes each)."""
    p, q = similarity

    @F.pandas_udf("digest long, fp long, size int, prefix array<long>, spread binary")
    def prefixes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common, counts = box.value
        for texts in _few(batches):
            out = []
            for t in texts:
                every = hashes_of(t, words)
                h = np.unique(every.view("<i8"))
                n = len(h)
                rank = np.zeros(n, dtype=np.int64)
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    rank = np.where(common[at] == h, counts[at], 0)
                out.append((_digest(h), simhash.majority(simhash.bit_counts(every), len(every)), n, h[np.argsort(rank, kind="stable")][: n - -(-n * p // q) + 1 if n else 0], _spread(h)))
            yield pd.DataFrame(out, columns=["digest", "fp", "size", "prefix", "spread"])

    return prefixes(text)


def _enough(shared: Column, a: Column, b: Column, similarity: tuple[int, int]) -> Column:
    """shared / (a + b - shared) >= p / q, in whole numbers."""
    p, q = similarity
    return shared * F.lit(p + q).cast("long") >= (a + b).cast("long") * F.lit(p).cast("long")


def _grouped(df: DataFrame, id: str, text: str, words: int, similarity: tuple[int, int], radius: int) -> DataFrame:
    """(id, h, first) for each row whose id is not null: h tells texts of one id apart, first is the least (id, h) of the group."""
    df = df.select(F.col(id).alias("id"), F.col(text).alias("text")).filter("id is not null")
    box = df.sparkSession.sparkContext.broadcast(_common(df, "text", words))  # KEPT hashes and counts at most
    prints = store(df.select("id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("h"), _prefixes(F.col("text"), words, similarity, box).alias("p")).select("id", "row", "h", "p.*"), "prefixes")
    # rows of one id and one text are alike; that of least number stands for them
    nodes = store(prints.groupBy("digest", "fp").agg(F.min(F.struct("id", "h", "row")).alias("node")), "copies")
    firsts = prints.join(small(store(nodes.select(F.col("node.row").alias("row")), "first-rows")), "row", "left_semi")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs of digests that are similar. Pairs that the counts by class rule out go first, with half a
        kilobyte a text moved for each; only texts of the others are read again."""
        pairs = store(pairs.distinct(), "pairs")
        spread = firsts.select("digest", "size", "spread")
        both = pairs.join(spread.toDF("a", "na", "ha"), "a").join(spread.toDF("b", "nb", "hb"), "b")
        pairs = store(both.filter(_may_share(similarity)("ha", "hb", "na", "nb")).select("a", "b"), "likely-pairs")
        ends = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
        ids = small(store(nodes.join(ends, "digest", "left_semi").select(F.col("node.id").alias("_id"), F.col("node.h").alias("_h")).distinct(), "pair-ids"))
        read = df.join(ids, (F.col("id") == F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left_semi")
        sets = store(read.select(_named(F.col("text"), words).alias("p")).select("p.*").dropDuplicates(["digest"]), "shingle-sets")
        both = pairs.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")
        return store(both.filter(_enough(F.size(F.array_intersect("s", "t")).cast("long"), F.size("s"), F.size("t"), similarity)).select("a", "b").distinct(), "similar")

    # 1: covering tables; texts of one fingerprint meet at the least of them
    prints_of = store(nodes.groupBy("fp").agg(F.min("digest").alias("node")), "fingerprints")
    same = nodes.select("digest", "fp").join(small(prints_of), "fp").filter("digest <> node").select(F.col("node").alias("a"), F.col("digest").alias("b"))
    near = verified(simhash.links(prints_of.select("node", "fp"), radius).union(same))
    # 2: the prefixes of all, each bucket's least member first
    keys = firsts.select("digest", "size", F.posexplode("prefix").alias("at", "h"))
    keys = keys.select("h", "digest", F.struct("size", (F.col("size") - F.col("at")).alias("left")).alias("p"))
    bucket = W.partitionBy("h")
    met = keys.withColumn("hub", F.min(F.struct("digest", "p")).over(bucket)).withColumn("last", F.max("digest").over(bucket)).filter(F.col("hub.digest") < F.col("last")).drop("last")
    met = store(met, "shingles-met")

    def can(a: str, b: str) -> Column:
        """What is left of both from a shared shingle on is enough: true at the first that a similar pair shares."""
        return _enough(F.least(f"{a}.left", f"{b}.left").cast("long"), F.col(f"{a}.size"), F.col(f"{b}.size"), similarity)

    known = store(components(near), "known")
    named = lambda d, c: small(known).select(F.col("node").alias(d), F.col("component").alias(c))
    open_ = met.filter((F.col("digest") != F.col("hub.digest")) & can("p", "hub.p")).select(F.col("hub.digest").alias("a"), F.col("digest").alias("b")).distinct()
    open_ = open_.join(named("a", "ca"), "a", "left").join(named("b", "cb"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    stars = near.union(verified(open_))
    # 3: the rest of the buckets that still hold texts of different groups
    def mixed(rows: DataFrame) -> DataFrame:
        """The rows (h, digest, p) of buckets that hold texts of different groups, with the group."""
        found = store(components(stars).toDF("_digest", "c"), "found")
        at = rows.join(small(found), F.col("digest") == F.col("_digest"), "left").select("h", "digest", "p", F.coalesce("c", "digest").alias("c"))
        return store(at.withColumn("mixed", F.min("c").over(bucket) < F.max("c").over(bucket)).filter("mixed").drop("mixed"), "shingles-open")

    at = mixed(met.drop("hub"))
    # one other text of each bucket meets its members, the same in all buckets that hold it: that connects large groups of
    # near copies, whose pairs then need no comparison
    for n in range(ROUNDS):
        hub = F.min(F.struct(F.xxhash64(F.lit(n), "digest").alias("o"), "digest", "p", "c")).over(bucket)
        asked = at.withColumn("hub", hub).filter((F.col("c") != F.col("hub.c")) & can("p", "hub.p"))
        links = verified(asked.select(F.least("digest", "hub.digest").alias("a"), F.greatest("digest", "hub.digest").alias("b")))
        if links.isEmpty():
            break
        stars = stars.union(links)
        at = mixed(at.drop("c"))
    x, y = at.toDF("h", "a", "pa", "ca"), at.toDF("h", "b", "pb", "cb")
    rest = verified(x.join(y, "h").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & can("pa", "pb")).select("a", "b"))
    groups = nodes.join(components(stars.union(rest)).toDF("digest", "c"), "digest", "left").withColumn("c", F.coalesce("c", "digest"))
    least = groups.groupBy("c").agg(F.min(F.struct("node.id", "node.h")).alias("first"))
    names = store(groups.join(least, "c").select(F.col("digest").alias("_digest"), "first"), "groups")
    return prints.join(small(names), F.col("digest") == F.col("_digest")).select("id", "h", "first")


def near_copies(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, radius: int = 2) -> DataFrame:
    """(id, component_id), one row per row of df whose id is not null; component_id is the least id reachable over links.

    Texts link if the Jaccard similarity of their shingles is at least similarity; those without words are equal. Each
    pair at or above it is linked or connected by other verified links, and no other pair links. Equal sets are one
    node. radius: bits of the covering tables, which change only what is compared first. Other columns are ignored.
    """
    return _grouped(df, id, text, words, similarity, radius).select(F.col("id").alias(id), F.col("first.id").alias("component_id"))


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, radius: int = 2) -> DataFrame:
    """df with one row of each group of near copies: the one of least id, and of one id that of least text hash.

    Decided row by row: of rows that share id and text one stays, rows that share an id but not their group are judged
    apart, and rows of null id stay. Columns are as they are.
    """
    rows = store(_grouped(df, id, text, words, similarity, radius).groupBy("id", "h", "first").agg(F.count("*").alias("n")), "near-copies")
    stays = (F.col("first.id") == F.col("id")) & (F.col("first.h") == F.col("h"))
    _id, _h = free(df, "_id"), free(df, "_h")
    named = lambda d: d.select(F.col("id").alias(_id), F.col("h").alias(_h))
    gone, twice = small(store(named(rows.filter(~stays)), "gone")), store(named(rows.filter(stays & (F.col("n") > 1))), "twice")
    this = (df[id] == F.col(_id)) & (F.xxhash64(df[text]) == F.col(_h))
    kept = df.join(gone, this, "left_anti")
    if twice.isEmpty():
        return kept
    again = kept.join(small(twice), this, "left_semi").dropDuplicates([id, text])
    return kept.join(small(twice), this, "left_anti").unionByName(again)
