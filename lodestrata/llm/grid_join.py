"""Cosine near-duplicates of vectors by the epsilon grid order join.

Unit vectors of cosine c or more lie within epsilon = sqrt(2 - 2c). They are sorted by grid cells (FINE to an epsilon) of
their leading principal coordinates; the sequence is cut into intervals, and pairs of intervals are refined level by
level, down to parts of an interval and at last to single vectors, leaving out each pair that is provably distant. The
bound is that of sketches: the principal coordinates and the length of what is left. The cosine of two vectors is at most
the product of their sketches, and their distance at least that of their sketches. What stays is compared exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window as W

from lodestrata.llm.common import let, small, store
from lodestrata.llm.components import components

#: Vectors of an interval that one row carries, at most, and bytes of their components, about.
INTERVAL, INTERVAL_BYTES = 4096, 4 << 20
#: Vectors of a part of an interval, intervals of a range partition, nodes under a node of the next level.
PART, RANGE, FANOUT = 64, 4, 16
#: Intervals that are sent to meet one interval together.
MET = 4
#: Principal dimensions of the grid and of the sketches, and cells to an epsilon.
GRID_DIMS, SKETCH_DIMS, FINE = 8, 16, 4
#: Vectors that the principal directions are fitted on, about. They set what is left out, never the result.
SAMPLE = 20_000
#: Rounding that a sketch's product or a squared distance may be off by.
SLACK = 1e-5


def directions(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v, dim) of the rows whose vector has a direction: not null or empty, all finite, not zero."""
    v, kind = F.col("v"), df.schema[vector].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    at = df.select(F.col(id).alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull())
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return at.filter(good).select("id", "v", F.size("v").alias("dim"))


def units_of(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = raw.astype("<f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(at: DataFrame, n: int, dim: int) -> np.ndarray:
    """Leading principal directions of a sample by hash, orthonormal rows; any are right, these leave out most."""
    k = min(SKETCH_DIMS, dim)
    share = min(1.0, SAMPLE / n)
    some = at.filter(F.xxhash64(F.lit("axes"), "v") <= min(2**63 - 1, int((share - 0.5) * 2**64)))
    padded = F.concat(F.col("v").cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(dim) - F.col("dim")))
    # a scale of its own for each vector is enough here: the directions need no exact units
    scaled = let(padded, lambda v: let(F.greatest(F.array_max(v), -F.array_min(v)), lambda top: F.transform(v, lambda x: x / top)))
    some = store(some.select(scaled.alias("x")), "axes-sample").filter("size(x) > 0")
    if some.count() < 3:
        return np.eye(dim)[:k]
    fitted = PCA(k=k, inputCol="x", outputCol="y").fit(some.select(array_to_vector("x").alias("x")))
    q, _ = np.linalg.qr(fitted.pc.toArray())
    return q.T


def _sketched(at: DataFrame, dim: int, axes: np.ndarray, eps: float) -> DataFrame:
    """at with key (a digest of the vector), cell (sorts like the grid cells), raw and sketch as bytes."""
    kind = "<f4" if isinstance(at.schema["v"].dataType.elementType, FloatType) else "<f8"

    @F.pandas_udf("key binary, cell binary, raw binary, sketch binary")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vs in batches:
            raw = np.zeros((len(vs), dim), dtype=kind)
            for i, v in enumerate(vs):
                raw[i, : len(v)] = v
            raw += 0.0  # no negative zeros
            unit = units_of(raw) if len(raw) else raw.astype("<f8")
            at = unit @ axes.T
            rest = np.sqrt(np.maximum(0.0, 1 - (at * at).sum(axis=1, keepdims=True)))
            cells = np.clip(np.floor(at[:, :GRID_DIMS] / (eps / FINE)) + 32768, 0, 65535).astype(">u2") if eps > 0 else np.zeros((len(at), 1), dtype=">u2")
            sketch = np.hstack([at, rest]).astype("<f4")
            yield pd.DataFrame({
                "key": [hashlib.md5(len(v).to_bytes(4, "big") + r.tobytes(), usedforsecurity=False).digest() for v, r in zip(vs, raw, strict=True)],
                "cell": [c.tobytes() for c in cells], "raw": [r.tobytes() for r in raw], "sketch": [s.tobytes() for s in sketch],
            })

    return at.select("id", "dim", F.monotonically_increasing_id().alias("row"), sketches("v").alias("s")).select("id", "dim", "row", "s.*")


def _packed(nodes: DataFrame, n: int, dim: int, width: int, kind: str) -> tuple[DataFrame, int]:
    """(one row for each interval of the sequence: its vectors as bytes and the box of their sketches; range partitions)."""
    size = max(PART, min(INTERVAL, INTERVAL_BYTES // (dim * int(kind[-1]))))
    parts = max(1, math.ceil(n / (RANGE * size)))
    placed = nodes.repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead, nth, held = TaskContext.get().partitionId(), 0, []

        def block(f: pd.DataFrame) -> pd.DataFrame:
            s = np.frombuffer(b"".join(f["sketch"]), dtype="<f4").reshape(len(f), width).astype("<f8")
            whole = {c: [f[c].to_numpy(dtype="<i8").tobytes()] for c in ("id", "copies", "dim")} | {c: [b"".join(f[c])] for c in ("raw", "sketch")}
            return pd.DataFrame({"part": [lead], "interval": [lead << 32 | nth], **whole, "lo": [s.min(0)], "hi": [s.max(0)]})

        for f in frames:
            held.append(f)
            while sum(map(len, held)) >= size:
                f = pd.concat(held, ignore_index=True)
                yield block(f[:size])
                held, nth = [f[size:]], nth + 1
        f = pd.concat(held, ignore_index=True) if held else None
        if f is not None and len(f):
            yield block(f)

    got = placed.select("id", "copies", "dim", "raw", "sketch").mapInPandas(pack, "part int, interval long, id binary, copies binary, dim binary, raw binary, sketch binary, lo array<double>, hi array<double>")
    return store(got, "grid-intervals"), parts


def _near(eps: float):
    gap = F.aggregate(F.zip_with(F.zip_with("lo1", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi1", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    return gap <= eps * eps + SLACK


def _interval_pairs(packed: DataFrame, parts: int, width: int, eps: float) -> DataFrame:
    """Pairs (i, j), i <= j, of intervals that may hold vectors within eps, found from the whole sequence down."""
    box = [F.array(*(of(F.col(side)[k]) for k in range(width))).alias(side) for side, of in (("lo", F.min), ("hi", F.max))]
    levels = [store(packed.select(F.col("part").cast("long").alias("up"), F.col("interval").alias("x"), "lo", "hi"), "grid-boxes")]
    while True:
        up = levels[-1].groupBy(F.col("up").alias("x")).agg(*box)
        levels.append(store(up.select(F.floor(F.col("x") / FANOUT).alias("up"), "x", "lo", "hi"), "grid-boxes"))
        if parts <= 1:
            break
        parts = math.ceil(parts / FANOUT)
    pairs = levels.pop().select(F.col("x").alias("i"), F.col("x").alias("j"))
    while levels:
        below = levels.pop()
        one, two = (below.select(F.col("up").alias(up), F.col("x").alias(x), F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}")) for k, up, x in ((1, "i", "x1"), (2, "j", "x2")))
        pairs = store(pairs.join(one, "i").join(two, "j").filter("x1 <= x2").filter(_near(eps)).select(F.col("x1").alias("i"), F.col("x2").alias("j")), "grid-pairs")
    return pairs


def _boxes(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = range(0, len(sketch), PART)
    return np.stack([sketch[c : c + PART].min(0) for c in cuts]), np.stack([sketch[c : c + PART].max(0) for c in cuts])


def tile(one: dict, two: dict, same: bool, cosine: float) -> pd.DataFrame:
    """For each linked vector of two intervals the copies linked there and the least id reached; a forest of the links."""
    (lo1, hi1), (lo2, hi2) = _boxes(one["sketch"]), _boxes(two["sketch"])
    near = (np.maximum(np.maximum(lo1[:, None] - hi2[None], lo2[None] - hi1[:, None]), 0) ** 2).sum(2) <= 2 - 2 * cosine + SLACK
    ids, off = (one["id"], 0) if same else (np.concatenate([one["id"], two["id"]]), len(one["id"]))
    order = np.argsort(ids, kind="stable")
    label = np.empty(len(ids), dtype=np.int64)
    label[order] = np.arange(len(ids))
    n = np.zeros(len(ids))
    for a, parts in enumerate(near):
        if same:
            parts = parts & (np.arange(len(parts)) >= a)
        cols = np.nonzero(np.repeat(parts, PART)[: len(two["id"])])[0]
        if not len(cols):
            continue
        rows = np.arange(a * PART, min((a + 1) * PART, len(one["id"])))
        may = one["sketch"][rows] @ two["sketch"][cols].T >= cosine - SLACK
        cols = cols[may.any(0)]
        if not len(cols):
            continue
        s = one["unit"][rows] @ two["unit"][cols].T >= cosine
        s &= one["dim"][rows, None] == two["dim"][None, cols]
        if same:
            s &= cols[None] > rows[:, None]
        n[rows] += s @ two["copies"][cols].astype(float)
        n[off + cols] += one["copies"][rows].astype(float) @ s
        for r in np.nonzero(s.any(1))[0]:
            met = np.unique(np.append(label[off + cols[s[r]]], label[rows[r]]))
            if len(met) > 1:
                to = np.arange(len(ids))
                to[met] = met[0]
                label = to[label]
    hit = n > 0
    return pd.DataFrame({"id": ids[hit], "n": n[hit].astype("int64"), "root": ids[order[label]][hit]})


def _join(cosine: float, width: int, kind: str):
    def read(row) -> dict:
        x = {c: np.frombuffer(getattr(row, c), dtype="<i8") for c in ("id", "copies", "dim")}
        raw = np.frombuffer(row.raw, dtype=kind).reshape(len(x["id"]), -1)
        return x | {"unit": units_of(raw), "sketch": np.frombuffer(row.sketch, dtype="<f4").reshape(-1, width)}

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The interval that the others meet comes first and stays; they pass one by one."""
        one: dict = {}
        for f in frames:
            for row in f.itertuples(index=False):
                if row.j < 0:
                    one = read(row)
                    continue
                got = tile(one, one if row.i == row.j else read(row), row.i == row.j, cosine)
                if len(got):
                    yield got

    return join


def linked_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of df: other vectors of that cosine or more, and who is reached.

    Vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing, and so do vectors of
    different length. Equal vectors are compared once for all their copies. Rows that share an id count as one
    vector name; a row with a null id links with nothing and has a null component. An empty table gives an empty result.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    at = directions(df, id, vector)
    n, dim = at.agg(F.count("*"), F.max("dim")).first()
    rows = df.select(F.col(id).alias("id"))
    if not n:
        return rows.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    kind = "<f4" if isinstance(at.schema["v"].dataType.elementType, FloatType) else "<f8"
    axes = _axes(at, n, dim)
    width = len(axes) + 1
    units = store(_sketched(at, dim, axes, eps), "sketches")
    groups = store(units.groupBy("key").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("copies")).select("key", F.col("first.id").alias("node"), F.col("first.row").alias("row"), "copies"), "directions")
    nodes = units.join(groups.select("row", "copies"), "row").select("id", "copies", "dim", "cell", "raw", "sketch")
    packed, parts = _packed(nodes, n, dim, width, kind)
    pairs = _interval_pairs(packed, parts, width, eps)
    pairs = store(pairs.withColumn("g", F.floor((F.row_number().over(W.partitionBy("i").orderBy("j")) - 1) / MET)), "grid-meetings")
    block = [F.col(c) for c in ("id", "copies", "dim", "raw", "sketch")]
    side = lambda x: packed.select(F.col("interval").alias(x), *block)
    first = pairs.select("i", "g").distinct().join(side("i"), "i").select("i", "g", F.lit(-1).cast("long").alias("j"), *block)
    own = pairs.filter("i = j").select("i", "g", "j", *(F.lit(None).cast("binary").alias(c) for c in ("id", "copies", "dim", "raw", "sketch")))
    others = pairs.filter("i < j").join(side("j"), "j").select("i", "g", "j", *block)
    meetings = pairs.select("i", "g").distinct().count()
    dealt = first.union(own).union(others).repartition(max(1, min(meetings, 20_000)), "i", "g").sortWithinPartitions("i", "g", "j")
    found = store(dealt.mapInPandas(_join(cosine, width, kind), "id long, n long, root long"), "grid-links")
    reached = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = groups.join(counts.withColumnRenamed("id", "node"), "node", "left").join(reached, "node", "left").filter("copies > 1 or n is not null")
    named = small(store(named.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("component")), "linked-directions"))
    linked = units.select("id", "key").join(named, "key").groupBy("id").agg(F.sum("n").alias("n"), F.min("component").alias("component"))
    linked = small(store(linked.withColumnRenamed("id", "_id"), "linked-vectors"))
    out = rows.join(linked, F.col("id") == F.col("_id"), "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
