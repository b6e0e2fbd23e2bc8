"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With C the centred rows, blocks V_1, V_2... (orthonormal, as wide as a vector, on the driver) and U_1, U_2... (orthonormal,
as long as the table) are made in turn: one pass gives C V_k and its products with all earlier U (full
reorthogonalisation), a second one what is left of it, its length and C' U_k, which gives V_(k+1). U is never
stored: it is C W for a small W, so a task makes its rows of U from its rows of C. What a pass sends is some
d x (8 + K) sums for each task, whatever the number of rows. The K x K matrix U' C V is block bidiagonal; its
singular values are those of C, and its right vectors give the components. A block of one vector gives the textbook
bidiagonal matrix; wider blocks need fewer passes. It ends where the residual of the components asked for is rounding
noise, at the latest where V fills the space of the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import store

#: Components, vectors of a block, and parts of 1 and offset of a whole number that an entry becomes.
COMPONENTS, BLOCK, SCALE, OFFSET = 8, 8, 1024, 100_000
#: Rows that a task multiplies at a time; share of the largest variance below which a direction has none.
ROWS, NOTHING = 4096, 1e-20
#: Entries of a larger size are taken as not finite: their whole numbers would not be exact.
LARGEST = 2.0**40


def whole_numbers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(offset).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, not empty, no entry null, not finite or beyond LARGEST."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= LARGEST))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def _chunks(column: pa.ListArray, d: int) -> Iterator[np.ndarray]:
    for i in range(0, len(column), ROWS):
        yield column.slice(i, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(rows: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """of(rows of x), a flat array of one length, summed over all rows: each task adds up its own first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for x in _chunks(batch.column(0), d):
                out = of(x) if out is None else out + of(x)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["i", "v"])

    got = rows.select("x").mapInArrow(add, f"i long, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(got, key=lambda r: r["i"])])


def _orthonormal(z: np.ndarray, against: np.ndarray, size: float) -> np.ndarray:
    """Orthonormal directions of z that are not in the columns of against; those shorter than rounding of size are none."""
    for _ in range(2):
        z = z - against @ (against.T @ z)
    left, s, _ = np.linalg.svd(z, full_matrices=False)
    left = left[:, s > 1e-13 * size]
    left = left - against @ (against.T @ left)
    return np.linalg.qr(left)[0]


def bidiagonalise(rows: DataFrame, mean: np.ndarray, components: int = COMPONENTS, block: int = BLOCK, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of the centred rows of x, the largest first."""
    d = len(mean)
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(block, d))))[0]
    all_v, w, ctu = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V, and W and C'U of the U so far
    largest = 0.0
    while v.shape[1]:
        all_v, b, k = np.hstack([all_v, v]), v.shape[1], w.shape[1]

        def product(x: np.ndarray, v: np.ndarray = v, w: np.ndarray = w) -> np.ndarray:
            c = x - mean
            p = c @ v
            return np.hstack([c @ w, p]).T @ p

        got = _sums(rows, d, lambda x: product(x).ravel()).reshape(k + b, b)
        largest = max(largest, float(np.trace(got[k:])))
        rest = v - w @ got[:k]  # C rest is C V_k less its shares in U

        def again(x: np.ndarray, q: np.ndarray = rest, w: np.ndarray = w) -> np.ndarray:
            c = x - mean
            q = c @ q
            return np.hstack([c @ w, q, c]).T @ q

        got = _sums(rows, d, lambda x: again(x).ravel()).reshape(k + b + d, b)
        share, gram, ctq = got[:k], got[k : k + b], got[k + b :]
        g, e = np.linalg.eigh(gram - share.T @ share)
        e, g = e[:, g > NOTHING * max(largest, 1e-300)], g[g > NOTHING * max(largest, 1e-300)]
        r = e / np.sqrt(g)
        w = np.hstack([w, (rest - w @ share) @ r])
        new = (ctq - ctu @ share) @ r  # C' U_k
        ctu = np.hstack([ctu, new])
        left, s, right = np.linalg.svd(ctu.T @ all_v)  # U' C V: block bidiagonal
        top = min(components, len(s))
        v = _orthonormal(new, all_v, float(np.sqrt(largest)))
        if all_v.shape[1] + v.shape[1] > d:
            v = v[:, : d - all_v.shape[1]]
        # what C' U P leaves outside V: the residual of each pair of singular vectors
        over = (v.T @ ctu @ left[:, :top]) if v.shape[1] else np.zeros((1, top))
        if not len(s) or top == components and np.linalg.norm(over, axis=0).max() <= 1e-15 * s[0]:
            break
    if not ctu.shape[1]:
        return np.zeros(0), np.zeros((d, 0))
    return s[:components], (all_v @ right.T)[:, : min(components, len(s))]


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, block: int = BLOCK, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row for each usable vector and component.

    Entries become x = floor(scale c) + offset; all usable vectors are the fit list. deviation is decimal(38,0), the sum of
    (n x - S)^2 (null beyond 38 digits). Vectors that are null, empty or have null, not finite or enormous (LARGEST)
    entries are left out, as are those of another length than most (of two lengths as common, the longer counts).
    Directions without variance have no component: equal vectors, one vector or an empty table give no rows. Repeated
    rows and repeated or null ids are rows like any other. Other columns are ignored.
    """
    spark = df.sparkSession
    v = F.col(f"`{vector}`")
    rows = store(df.filter(usable(v)).select(F.col(f"`{id}`").alias("id"), whole_numbers(v, scale, offset).alias("x")), "whole-numbers")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    kind = f"{id} {df.schema[id].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], kind)
    d, n = lengths[0]["d"], lengths[0]["n"]
    rows = rows.filter(F.size("x") == d)
    total = np.array(_exact_sums(rows, d), dtype=object)
    mean = np.array([t / n for t in total], dtype=np.float64)  # whole numbers: rounded once
    s, vectors = bidiagonalise(rows, mean, components, block)
    trace = float(_sums(rows, d, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n
    e = s * s / n
    at = e > 1e-24 * max(trace, 1e-300)
    e, vectors = e[at], vectors[:, at]
    if not len(e):
        return spark.createDataFrame([], kind)
    to = vectors / np.sqrt(e)
    k = len(e)

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ to
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    got = _sums(rows, d, moments) / n
    error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for x in _chunks(batch.column(1), d):
                y = (x - mean) @ to
                out = [batch.column(0).slice(done, len(x)), pa.array(_deviations(x, n, total), pa.decimal128(38, 0)), pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), k).cast(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(out, ["id", "deviation", "y"])
                done += len(x)

    made = rows.mapInArrow(project, f"id {df.schema[id].dataType.simpleString()}, deviation decimal(38,0), y array<double>")
    share = F.array(*(F.lit(float(x)) for x in e / trace))
    return made.select(F.col("id").alias(id), "deviation", F.posexplode("y").alias("c", "whitened")).select(
        id, (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("c")).alias("explained"), F.lit(error).alias("identity_error")
    )


def _exact_sums(rows: DataFrame, d: int) -> list[int]:
    """Sums of each place, exact: the low 31 bits and the rest are added apart, in 64 bits."""

    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x & 0x7FFFFFFF).sum(axis=0), (x >> 31).sum(axis=0)])

    got = _sums(rows, d, halves, "long")
    return [int(low) + (int(high) << 31) for low, high in zip(got[:d], got[d:], strict=True)]


def _deviations(x: np.ndarray, n: int, total: np.ndarray) -> list:
    """Sum of (n x - S)^2 of each row, exact: in 64 bits where no step can leave them, else in whole numbers of any size."""
    most = max(abs(int(x.max())), abs(int(x.min()))) * n + max(abs(int(t)) for t in total)
    if most < 1 << 62:
        off = x * n - total.astype(np.int64)
        far = int(np.abs(off).max())
        if far * far * x.shape[1] < 1 << 62:
            return [int(q) for q in (off * off).sum(axis=1)]
        off = off.astype(object)
    else:
        off = x.astype(object) * n - total
    out = [int(q) for q in (off * off).sum(axis=1)]
    return [q if q < 10**38 else None for q in out]
