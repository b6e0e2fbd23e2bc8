"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of r + 1 bits; table v (any non-zero vector) keeps the bits whose vector has
an odd overlap with v. Two fingerprints that differ in r bits or fewer span at most r dimensions, so some v is
orthogonal to all bits that differ, and in that table they collide: no pair within the radius is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import look_up, store
from lodestrata.llm.components import components

#: Buckets of at most so many different fingerprints are joined pair by pair; larger ones through shared neighbours.
PAIRWISE = 32
#: Shingles whose bits are counted at a time.
BLOCK = 32_768


def masks(radius: int) -> list[int]:
    """The covering tables' bit masks, as signed 64-bit values."""
    top = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, top + 1):
        m = sum(1 << i for i in range(64) if ((1 + i % top) & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def fingerprint_of(text: str, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash: bit i is 1 if it is set in over half of the hashes of all word shingles, repeats included."""
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return 0
    total, n = np.zeros(64, dtype=np.int64), max(1, len(w) - words + 1)
    for i in range(0, n, BLOCK):
        part = w[i : i + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
        total += bit_counts(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8"))
    return majority(total, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set; BLOCK of them at a time, so that a long text takes no more memory."""
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # counts of up to 255 fit a byte, which numpy adds much faster than wider numbers
        even = len(bits) // 255 * 255
        total += np.add.reduce(np.add.reduce(bits[:even].reshape(-1, 255, 64), axis=1, dtype=np.uint8), axis=0, dtype=np.int64)
        total += np.add.reduce(bits[even:], axis=0, dtype=np.int64)
    return total


def majority(total: np.ndarray, n: int) -> int:
    """The signed 64-bit number of the bits that over half of n hashes have."""
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """64-bit SimHash of a text as a long; null and texts without words give 0."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t, words) if t else 0 for t in texts], dtype="int64")

    return fingerprints(text)


def _ball(free: int, radius: int) -> list[int]:
    """All sets of at most radius bits of free."""
    bits = [i for i in range(64) if free >> i & 1]
    out = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(bits, k)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between nodes (node, fp), of different fp each, that leave fps within the radius connected, and no others.

    A table's small bucket is compared pair by pair. In a large one each fingerprint is written under every value
    within half the radius of it (in the bits that the table masks out); those that meet under a value are within the
    radius of one another and become a star. No bucket is capped and no group is expanded into all its pairs.
    """
    tables = [(v, m) for v, m in enumerate(masks(radius))]
    keys = nodes.select("node", "fp", F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for v, m in tables))).alias("k")).select("node", "fp", "k.v", "k.key")
    shared = keys.groupBy("v", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = store(keys.join(shared, ["v", "key"]), "buckets")
    few = met.filter(F.col("n") <= PAIRWISE).groupBy("v", "key").agg(F.collect_list(F.struct("node", "fp")).alias("g"))
    near = lambda x: F.transform(F.filter("g", lambda y: (y["node"] < x["node"]) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= radius)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))
    pairs = few.select(F.explode(F.flatten(F.transform("g", near))).alias("e")).select("e.a", "e.b")
    lo, hi = radius // 2, (radius + 1) // 2
    rules = F.lit(None)
    for v, m in tables:
        free = ~m & (2**64 - 1)
        inner = set(_ball(free, lo))
        rules = F.when(F.col("v") == v, F.array(*(F.struct(F.lit(x).cast("long").alias("x"), F.lit(x in inner).alias("core")) for x in _ball(free, hi)))).otherwise(rules)
    spread = met.filter(F.col("n") > PAIRWISE).select("v", "node", "fp", F.explode(rules).alias("r")).select("v", F.col("fp").bitwiseXOR(F.col("r.x")).alias("z"), "node", "r.core")
    stars = spread.groupBy("v", "z").agg(F.min(F.when(F.col("core"), F.col("node"))).alias("b"), F.collect_list("node").alias("g")).filter(F.col("b").isNotNull() & (F.size("g") > 1))
    return pairs.union(stars.select(F.explode("g").alias("a"), "b").filter("a <> b")).distinct()


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """(id, fingerprint, component_id), one row per row of df; component_id is the least id reachable over links.

    Equal fingerprints are one node, so exact copies cost one comparison. Texts without words and nulls have
    fingerprint 0 and link like any other. A null id keeps its row; it is no component's name unless all are null.
    Rows with the same id keep their own fingerprints; an empty table gives an empty result; other columns are ignored.
    """
    prints = store(df.select(F.col(id).alias("id"), fingerprint(F.col(text), words).alias("fp")), "fingerprints")
    nodes = store(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
    found = components(links(nodes.filter("least is not null").select(F.col("least").alias("node"), "fp"), radius))
    named = nodes.join(found, nodes["least"] == found["node"], "left").filter("n > 1 or component is not null")
    named = store(named.select(F.col("fp").alias("_fp"), F.coalesce("component", "least").alias("component_id")), "components")
    # a row that shares its fingerprint with none and links with none is its own component
    out = look_up(prints, F.col("fp"), named, "_fp")
    return out.select(F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "id").alias("component_id"))
