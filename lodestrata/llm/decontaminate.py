"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window of an item is the ordered set of its word shingles. A document that contains the window contains all of them,
so it is enough to look for one, the rarest in the corpus: the window's necessary prefix at full containment. The place
where it is found fixes where the window must start (positional bound) and end (length bound); every other shingle of
the window is then looked up at its place, word by word. Hashes only choose what to look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.llm.common import free, ascii_lower, small, store

#: Fixed value: what separates words, after A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle; bytes, at most, of the table that tells most shingles from the windows'.
SHINGLE, SLOTS = 3, 1 << 23


def words_of(text: Column) -> Column:
    """Lower-cased words in order; null has none."""
    return F.coalesce(F.filter(F.split(ascii_lower(text), BETWEEN_WORDS), lambda w: w != ""), F.array().cast("array<string>"))


def _hashes(words: Column, k: int) -> Column:
    """Hashes of the k words from each place on; the last k - 1 are of fewer words."""
    return F.transform(words, lambda w, i: F.xxhash64(F.lit(k), w, *(F.get(words, i + d) for d in range(1, k))))


def _run(words: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, n), " ")


def windows_of(items: DataFrame, id: str = "item_id", text: str = "text", size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(window, length, k, words) of the different windows, size consecutive words or all of a shorter item, and (window, item)."""
    w = items.select(F.coalesce(F.col(id).cast("string"), F.lit("null")).alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    each = w.withColumn("length", F.least(F.lit(size), F.size("w"))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)))
    each = store(each.select("item", F.slice("w", F.col("at"), F.col("length")).alias("words")).distinct(), "item-windows")
    windows = each.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), F.size("words").alias("length"), F.least(F.lit(SHINGLE), F.size("words")).alias("k"), "words")
    windows = store(windows, "windows")
    return windows, store(each.join(windows.select("window", "words"), "words").select("window", "item"), "window-items")


def shingles_of(windows: DataFrame) -> DataFrame:
    """(window, length, needed, j, h, run): the shingles of each window by place, hashed and as words."""
    of = F.when(F.col("k") == 1, _hashes(F.col("words"), 1)).when(F.col("k") == 2, _hashes(F.col("words"), 2)).otherwise(_hashes(F.col("words"), SHINGLE))
    needed = F.col("length") - F.col("k") + 1
    each = windows.select("window", "length", "k", "words", needed.alias("needed"), F.posexplode(F.slice(of, F.lit(1), needed)).alias("j", "h"))
    return store(each.select("window", "length", "needed", "j", "h", _run(F.col("words"), F.col("j"), F.col("k")).alias("run")), "window-shingles")


def _sieve(known: DataFrame) -> bytes:
    """One byte for each value of a hash's last bits, 1 where some known hash has it: SLOTS bytes at most, whatever is known."""
    n = known.count()
    slots = min(SLOTS, 1 << max(12, (16 * n).bit_length()))
    table = bytearray(slots)
    for x in known.select(F.col("h").bitwiseAND(F.lit(slots - 1)).alias("x")).distinct().toPandas()["x"]:
        table[x] = 1
    return bytes(table)


def _met(docs: DataFrame, id: str, text: str, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(row, id, n_words, place, h, run) of one scan: place -1 for each row itself, and the shingles that some window has.

    Rows get a number of their own in that scan, so that equal ids, equal texts and nulls stay apart. Most shingles of
    the documents are told from all known ones by a look-up within the row, and never become rows.
    """
    known = store(shingles.select("h").distinct(), "known-shingles")
    sieve = _sieve(known)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), words_of(F.col(text)).alias("w"))
    each = [F.array(F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("h"), F.lit(None).cast("string").alias("run")))]
    for k in sizes:
        hash_at = lambda w, i, k=k: F.xxhash64(F.lit(k), w, *(F.get("w", i + d) for d in range(1, k)))
        may = lambda h: F.substring(F.lit(sieve), h.bitwiseAND(F.lit(len(sieve) - 1)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
        places = F.array_compact(F.transform("w", lambda w, i: F.when(may(hash_at(w, i)), i)))  # noqa: B023
        each.append(F.transform(places, lambda i: F.struct(i.alias("place"), hash_at(F.get("w", i), i).alias("h"), _run(F.col("w"), i, F.lit(k)).alias("run"))))  # noqa: B023
    at = rows.select("row", "id", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(*each)).alias("s")).select("row", "id", "n_words", "s.*")
    at = at.join(small(known.withColumn("known", F.lit(True))), "h", "left").filter("known or place < 0")
    return store(at.select("row", "id", "n_words", "place", "h", "run"), "shingles-met")


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, items), one row per row of docs.

    A word inside any occurrence of any window is hit. Null texts have no words and are not contaminated; a null item id
    is named "null"; items without words have no window. Repeated rows each get their own result. Whole texts are read,
    once; only shingles that some window has leave the scan. Windows and their shingles are broadcast while they are
    small; a document's hit words are counted over its sorted windows, and only its different items are gathered.
    """
    windows, named = windows_of(items, item_id, item_text, size)
    shingles = shingles_of(windows)
    sizes = sorted({SHINGLE} | {r[0] for r in windows.select("k").distinct().collect()})  # at most SHINGLE of them
    met = _met(docs, id, text, shingles, sizes)
    heads, hits = met.filter("place < 0").select("row", "id", "n_words"), met.filter("place >= 0").drop("id")
    seen = hits.groupBy("h").agg(F.count("*").alias("seen"))
    prefix = shingles.join(seen, "h").groupBy("window", "length", "needed").agg(F.min_by(F.struct("j", "h"), F.struct("seen", "h", "j")).alias("p"), F.count("*").alias("held")).filter("held = needed")
    prefix = store(prefix.select("window", "length", "p.j", "p.h"), "prefixes")
    start = F.col("place") - F.col("j")
    candidates = hits.join(small(prefix), "h").select("row", "n_words", "window", "length", start.alias("start")).filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    wanted = candidates.select("row", "window", "length", "start").join(small(shingles.select("window", "needed", "j", "run")), "window").withColumn("place", F.col("start") + F.col("j"))
    # a place has one shingle of each size, and no two windows of one start and length are equal
    held = hits.select("row", "place", "run").distinct()
    found = wanted.join(held, ["row", "place", "run"]).groupBy("row", "window", "length", "start", "needed").agg(F.count("*").alias("n")).filter("n = needed")
    found = store(found.select("row", "window", "start", (F.col("start") + F.col("length")).alias("end")), "windows-found")
    before = F.coalesce(F.max("end").over(W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.col("end") - F.greatest("start", before), F.lit(0))
    words = found.select("row", "start", "end").distinct().select("row", fresh.alias("n")).groupBy("row").agg(F.sum("n").alias("n_hit"))
    of = found.select("row", "window").distinct().join(small(named), "window").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    per_row = small(store(words.join(of, "row").withColumnRenamed("row", "_row"), "contaminated-rows"))
    out = heads.join(per_row, F.col("row") == F.col("_row"), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        listed.alias("items"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents in which a window of an item occurs; columns as they are. Rows go by id and text together."""
    _id, _h = free(docs, "_id"), free(docs, "_h")
    keyed = docs.select(F.struct(F.col(id).alias("id"), F.xxhash64(text).alias("h")).alias("key"), F.col(text).alias("text"))
    hit = contamination(keyed, items, "key", "text").filter("contaminated").select(F.col("key.id").alias(_id), F.col("key.h").alias(_h)).distinct()
    return docs.join(small(store(hit, "contaminated")), docs[id].eqNullSafe(F.col(_id)) & (F.xxhash64(docs[text]) == F.col(_h)), "left_anti")
