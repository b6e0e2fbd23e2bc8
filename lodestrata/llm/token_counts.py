"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word form a linked list, its adjacent pairs a heap keyed by merge rank. The lowest pair is popped
again and again and merged in place; a word's count is its symbols minus its merges. No identifier is ever made.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts between spaces, and words, that a worker keeps counts of, and the longest such part. Beyond the first the cache starts anew.
CACHE_WORDS, CACHE_CHARS = 400_000, 48

#: Fixed value: the split pattern of byte-level BPE vocabularies, with white space as the Unicode property.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


@lru_cache(4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of a pattern with Unicode properties; text below U+0250 goes through the faster standard engine."""
    below = {"L": "", "N": "", "White_Space": " \t\n\r\x0b\x0c\x85\xa0"}
    for c in map(chr, range(0x250)):
        if (kind := unicodedata.category(c)[0]) in below:
            below[kind] += c
    quick = pattern
    for name, chars in below.items():
        quick = quick.replace(rf"\P{{{name}}}", f"[^{chars}]").replace(rf"[^\p{{{name}}}", f"[^{chars}").replace(rf"\p{{{name}}}", chars if name != "White_Space" else f"[{chars}]")
    for name in ("L", "N"):  # what stands in a class already needs no brackets of its own
        quick = quick.replace(f"?{below[name]}+", f"?[{below[name]}]+").replace(f"|{below[name]}", f"|[{below[name]}]")
    whole, quick, beyond = regex.compile(pattern).findall, re.compile(quick).findall, re.compile("[^\x00-\u024f]").search
    return lambda text: whole(text) if beyond(text) else quick(text)


@lru_cache(1)
def byte_symbols() -> dict[int, str]:
    """Byte-level vocabularies name each byte by one printable character: itself, or the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merges_needed(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Merges that byte-pair encoding makes in a word of these symbols."""
    n = len(symbols)
    if n < 2:
        return 0
    symbols, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if symbols[i] else -1
        if j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two is gone or has grown
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = k = after[j]
        merges += 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return merges


class _Words(dict):
    """Word to number of tokens, filled on demand and bounded."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.ranks, self.names = ranks, byte_symbols()

    def __missing__(self, word: str) -> int:
        symbols = [self.names[b] for b in word.encode("utf-8", "replace")]
        n = len(symbols) - merges_needed(symbols, self.ranks)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


class _Parts(dict):
    """The same for what stands between two spaces; lead: the space before it."""

    def __init__(self, words: _Words, lead: str):
        self.words, self.lead, self.split = words, lead, splitter(BYTE_LEVEL)

    def __missing__(self, part: str) -> int:
        n = sum(map(self.words.__getitem__, self.split(self.lead + part)))
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[part] = n
        return n


class TokenCounter:
    """Counts of a byte-level BPE file of the tokenizers library (byte_bpe_50k.json and its like)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        ranks = {tuple(p): i for i, p in enumerate(pairs)}
        words = _Words(ranks)
        self.first, self.later = _Parts(words, ""), _Parts(words, " ")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.spaces = regex.compile(r"\p{White_Space} ")

    def part(self, text: str) -> int:
        """Words never cross a single space, which leads the next word; a space after other white space may belong to it."""
        if not text:
            return 0
        if "  " in text or self.spaces.search(text):
            return self.first.__missing__(text)
        first, *later = text.split(" ")
        return self.first[first] + sum(map(self.later.__getitem__, later))

    def count(self, text: str) -> int:
        parts = self.added.split(text) if self.added else [text]
        return len(parts) - 1 + sum(map(self.part, parts))


@lru_cache(4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def n_tokens(text: Column, vocabulary: str) -> Column:
    """Tokens of each text as the vocabulary's library counts them, without added begin or end tokens. Null counts as empty: 0."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(vocabulary)
        for texts in batches:
            yield pd.Series([c.count(t) if t else 0 for t in texts], dtype="int64")

    return counted(text)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 512) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit) instead of any columns of these names.

    A null text counts as empty (0 bytes, 0 tokens). Rows, repeated ones too, keep their number; an empty table
    stays empty. A text is never cut; a word of any length takes time in proportion to n log n.
    """
    return df.withColumns({"n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"), "n_tokens": n_tokens(F.col(text), vocabulary)}).withColumn("over_limit", F.col("n_tokens") > limit)
