"""Importance resampling towards a target by hashed word n-grams, found with an Aho-Corasick dictionary.

Words of many texts are joined by one delimiter, and the distinct ones, with a delimiter on both sides, make an automaton
whose payloads are a word's CRC-32 and length. One scan emits the payloads in order. The CRC of two neighbours is
composed from their payloads alone (crc(a + b) is crc(a) moved on by len(b) zero bytes, xor crc(b)), so no n-gram is
ever spelled out; remainders of the CRCs are the buckets that are counted and scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import store

#: Buckets of features, added to the counts of each, and the share of eligible rows that is drawn, as a fraction.
BUCKETS, SHARE, LEAST_WORDS = 10_000, (25, 100), 20
#: Bytes of text whose words share a dictionary, and bytes of a word beyond which it is not put into one.
BLOCK, LONGEST = 4 << 20, 512
#: Neighbours composed at a time.
STEP = 1 << 20

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def _times(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A matrix over bits, given by the images of the 32 single bits, applied to each x."""
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where(x >> np.uint32(i) & np.uint32(1), rows[i], np.uint32(0))
    return out


@lru_cache(maxsize=4096)
def moved(n: int) -> np.ndarray:
    """Tables (4 x 256) that move a CRC on by n zero bytes: the xor of one entry for each of its bytes."""
    op = np.array([(1 << (i - 1)) if i else 0xEDB88320 for i in range(32)], dtype=np.uint32)  # one zero bit
    out, k = np.uint32(1) << np.arange(32, dtype=np.uint32), 8 * n
    while k:
        if k & 1:
            out = _times(op, out)
        op, k = _times(op, op), k >> 1
    return _times(out, np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None])


def move_on(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC moved on by its number of zero bytes."""
    lengths, which = np.unique(n, return_inverse=True)
    tables = np.stack([moved(int(x)) for x in lengths]) if len(lengths) else np.zeros((0, 4, 256), dtype=np.uint32)
    out = np.zeros(len(crc), dtype=np.uint32)
    for part in range(4):
        out ^= tables[which, part, (crc >> np.uint32(8 * part)) & np.uint32(255)]
    return out


def payloads(words: list[bytes]) -> np.ndarray:
    """CRC | length << 32 of each word, by one scan of an automaton of the distinct ones."""
    import ahocorasick

    dictionary, held, long = ahocorasick.Automaton(ahocorasick.STORE_INTS), [], {}
    for w in set(words):
        payload = zlib.crc32(w) | len(w) << 32
        if len(w) <= LONGEST:  # entries hold the place of their payload, which needs more than the 32 bits of an entry
            dictionary.add_word(f" {w.decode('latin-1')} ", len(held))
            held.append(payload)
        else:
            long[w] = payload
    if not long:
        text = b" ".join([b"", *words, b""]).decode("latin-1")
    else:  # "-" is no letter of any word: a place that no entry matches
        text = b" ".join([b"", *(b"-" if w in long else w for w in words), b""]).decode("latin-1")
    found = np.zeros(0, dtype=np.int64)
    if len(dictionary):
        dictionary.make_automaton()
        found = np.array(held, dtype=np.int64)[np.fromiter((p for _, p in dictionary.iter(text)), dtype=np.int64)]
    if not long:
        return found
    out = np.zeros(len(words), dtype=np.int64)
    at = np.fromiter((w in long for w in words), dtype=bool, count=len(words))
    out[~at], out[at] = found, np.fromiter((long[w] for w in words if w in long), dtype=np.int64)
    return out


def buckets_of(found: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all single words and all neighbours of one text, from its payloads in order."""
    crc, n = (found & 0xFFFFFFFF).astype(np.uint32), found >> 32
    out, space = [crc % np.uint32(buckets)], np.uint32(zlib.crc32(b" "))
    for i in range(0, len(crc) - 1, STEP):
        first, second, length = crc[i : i + STEP], crc[i + 1 : i + 1 + STEP], n[i + 1 : i + 1 + STEP]
        first = move_on(first[: len(second)], np.ones(len(second), dtype=np.int64)) ^ space
        out.append((move_on(first, length) ^ second) % np.uint32(buckets))
    return np.concatenate(out)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, BLOCK bytes or a little more at a time."""
    at = 0
    while at < len(text):
        cut = _GAP.search(text, at + BLOCK) if len(text) - at > BLOCK else None
        end = cut.start() if cut else len(text)
        yield _WORDS.findall(text, at, end)
        at = end


def scanned(texts: Iterator[str | None], buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of each text, in turn; texts share dictionaries of BLOCK bytes."""
    words: list[bytes] = []
    ends: list[int] = []  # where texts end in words
    head: list[np.ndarray] = []  # payloads of the blocks of a text that is not at its end
    size = 0

    def flush(last: bool) -> Iterator[np.ndarray]:
        found, at = payloads(words), 0
        for end in ends:
            yield buckets_of(np.concatenate([*head, found[at:end]]), buckets)
            head.clear()
            at = end
        if not last:
            head.append(found[at:])
        words.clear()
        ends.clear()

    for text in texts:
        data = (text or "").encode("utf-8", "replace").lower()
        for piece in _pieces(data):
            if size > BLOCK:
                yield from flush(False)
                size = 0
            words.extend(piece)
            size += sum(map(len, piece)) + len(piece)
        ends.append(len(words))
    yield from flush(True)


def features(df: DataFrame, id: Column, text: Column, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, features binary): the buckets of all single words and neighbours, two or four bytes each."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, size, start = batch.column(0), [], 0, 0
            for b in scanned((t.as_py() for t in batch.column(1)), buckets):
                out.append(((len(b) + 1) // 2, b.astype(kind).tobytes()))
                size += len(out[-1][1])
                if size > BLOCK:
                    yield made(ids, start, out)
                    start, size, out = start + len(out), 0, []
            if out:
                yield made(ids, start, out)

    def made(ids: pa.Array, start: int, out: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n, b = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([ids.slice(start, len(out)), pa.array(n, pa.int64()), pa.array(b, pa.binary())], ["id", "n_words", "features"])

    rows = df.select(id.alias("id"), text.alias("text"))
    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, features binary")


def bucket_counts(featured: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): each task adds its rows up before anything is shuffled."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for b in batch.column(0):
                n += np.bincount(np.frombuffer(b.as_py(), dtype=kind), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["bucket", "n"])

    return featured.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _counts(featured: DataFrame, buckets: int) -> np.ndarray:
    n = np.zeros(buckets, dtype=np.int64)
    for r in bucket_counts(featured, buckets).collect():  # a row for each bucket at most
        n[r["bucket"]] = r["n"]
    return n


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale ln) of how much likelier each bucket is in the target, one being added to every count."""
    a, b, n = float(source.sum() + len(source)), float(target.sum() + len(target)), zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(scale * math.log((t + 1) * a / ((s + 1) * b))) for s, t in n], dtype=np.int64)


def _weights(featured: DataFrame, gain: np.ndarray, buckets: int) -> DataFrame:
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, w = [], []
            for b in batch.column(2):
                f = np.frombuffer(b.as_py(), dtype=kind)
                n.append(len(f))
                w.append(int(gain[f].sum()) // len(f) if len(f) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(w, pa.int64())], ["id", "n_words", "n_features", "weight"])

    return featured.mapInArrow(weigh, f"id {featured.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df, stored, with rank 1, 2, 3... in the order: a range sort numbers rows within its partitions, and the partitions' counts
    (one row for each) give each its start, so that no task sees more than its range."""
    at = store(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "in-order")
    part = F.shiftrightunsigned("_at", 33)
    start, out = {}, 0
    for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        start[r["p"]], out = out, out + r["n"]
    starts = df.sparkSession.createDataFrame(list(start.items()) or [(-1, 0)], "_p long, _start long")
    # rows are numbered without gaps within a partition
    return at.join(F.broadcast(starts), part == F.col("_p")).withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_p", "_start")


def resample(
    docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text",
    share: tuple[int, int] = SHARE, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = 7,
) -> DataFrame:
    """(id, n_features, weight, score, rank): one row for each row of docs, drawn without replacement by Gumbel top-k.

    Features are all words and all pairs of neighbouring words, repeats counted; weight is the floored mean of their
    buckets' log ratios of target to docs. Of the N rows with at least so many words, floor(share x N) of the highest
    scores have a rank; others have none. Null and empty texts have no features and weight 0. A null id is hashed like
    an empty one and comes last among equal scores; repeated rows are judged each by itself. Empty tables give no rows,
    or counts of zero. Other columns are ignored.
    """
    featured = store(features(docs, F.col(id), F.col(text), buckets), "features")
    wanted = features(target, F.lit(0), F.col(target_text), buckets)
    gain = gains(_counts(featured, buckets), _counts(wanted, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    scored = store(_weights(featured, gain, buckets).withColumn("score", F.col("weight") + noise), "scores")
    n = scored.filter(F.col("n_words") >= least).count() * share[0] // share[1]
    # ranks are given to all that may be drawn, so that ties are settled before the cut
    order = ranked(scored.filter(F.col("n_words") >= least), F.desc("score"), F.asc_nulls_last("id"), "n_features", "weight")
    order = order.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    out = order.unionByName(scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id), "n_features", "weight", "score", "rank")
