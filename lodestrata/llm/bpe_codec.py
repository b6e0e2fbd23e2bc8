"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

Which merge happens at a place depends on the text to its right only as far as a chain of merges of falling rank
reaches. ``sufficient_lookahead`` computes that reach from the merge list. The encoder holds back no more than it: once
a token ends that far before the end of what has been read, no further text can change it, and it is emitted. What
follows an emitted token encodes as it would alone, since no merge ever crossed the token's end.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import free
from lodestrata.llm.token_counts import byte_symbols, splitter

#: Words a worker keeps codes of, and the longest such word. Beyond the first the cache starts anew.
CACHE_WORDS, CACHE_CHARS = 150_000, 48

#: Ids that a long word hands on together, and characters that are read at a time, up to the next white space.
RUN, READ = 8192, 1 << 16

#: Fixed value: the split pattern of word-end vocabularies; white space between the matches is dropped.
WORD_END = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


def sufficient_lookahead(merges: list[tuple[str, str]], end: str) -> tuple[int, int]:
    """(lookahead, longest token) in symbols, for merges in rank order; end: the word-end mark, part of a last symbol.

    reach[u, v]: symbols beyond uv that decide whether that merge happens where u and v stand. It is that of v's own
    making, or the length and reach of a right neighbour w that takes v first, by a merge (v, w) of lower rank.
    """
    length = lambda s: len(s) - len(end) + 1 - 1 if end and s.endswith(end) else len(s)
    made: dict[str, int] = {}
    taken: dict[str, int] = {}
    longest = 1
    for u, v in merges:
        reach = max(made.get(v, 0), taken.get(v, 0), made.get(u, 0) - length(v))
        made[u + v] = max(made.get(u + v, 0), reach)
        taken[u] = max(taken.get(u, 0), length(v) + reach)
        longest = max(longest, length(u + v))
    return max([0, *made.values(), *taken.values()]), longest


def merge_all(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The tokens of a whole word, lowest rank first and leftmost among equals."""
    n = len(symbols)
    symbols, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if symbols[i] else -1
        if j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return [s for s in symbols if s]


class Kept(dict):
    """Values of make(key), filled on demand and bounded."""

    def __init__(self, make: Callable[[str], str]):
        self.make = make

    def __missing__(self, key: str) -> str:
        value = self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = value
        return value


class Codec:
    """A word-end BPE file of the tokenizers library (word_bpe_49k.json and its like)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = model["vocab"] | self.special
        self.tokens = {i: t for t, i in self.ids.items()}
        self.lookahead, self.longest = sufficient_lookahead(merges, self.end)
        self.window = 4 * (self.lookahead + self.longest)
        self.names, self.words = byte_symbols(), splitter(WORD_END)
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.coded = Kept(self.word)

    def normal(self, text: str) -> str:
        """NFC, one space for a run of white space, and the lower case of each character by itself."""
        return self.spaces.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """Words of normal text. Characters that this Python's Unicode tables don't assign are no letters to the library."""
        if text.isascii() or not (new := {c for c in set(text) if unicodedata.category(c) == "Cn"}):
            return self.words(text)
        masked = text.translate({ord(c): "\x01" for c in new})
        return [text[m.start() : m.end()] for m in regex.finditer(WORD_END, masked)]

    def stream(self, chars: Iterable[str]) -> Iterator[str]:
        """Tokens of one word that arrives piece by piece, each as soon as no further piece can change it."""
        held: list[str] = []
        for piece in chars:
            held += map(self.names.__getitem__, piece.encode("utf-8", "replace"))
            if len(held) > self.window:
                used = 0
                for t in merge_all(held, self.ranks):
                    if len(held) - used - len(t) < self.lookahead + 1:
                        break
                    used += len(t)
                    yield t
                held = held[used:]
        if held:
            held[-1] += self.end
            yield from merge_all(held, self.ranks)

    def word(self, word: str) -> str:
        step = self.window
        return " ".join([str(self.ids[t]) for t in self.stream([word] if len(word) <= step else (word[i : i + step] for i in range(0, len(word), step)))])

    def run(self, text: str) -> str:
        """Ids of a text's words, joined by spaces; empty if it has no word. No word crosses white space, and normal text changes only within words."""
        return " ".join(map(self.coded.__getitem__, self.split(self.normal(text))))

    def pieces(self, text: str) -> Iterator[str]:
        """Ids of runs of the text, in order and joined by spaces; a special token's string is that token.

        READ characters are taken at a time, to the next space; what has no space for so long, to the next white space;
        what has none either, word by word; and a word as the transducer emits it. So beside the text itself memory
        does not grow with it.
        """
        for k, part in enumerate(self.added.split(text) if "<|" in text else [text]):
            if k % 2:
                yield str(self.special[part])
                continue
            for block in self.blocks(part):
                if len(block) <= 2 * READ:
                    if run := self.run(block):
                        yield run
                else:
                    for m in regex.finditer(r"\P{White_Space}+", block):
                        yield from self.unbroken(m[0])

    @staticmethod
    def blocks(part: str) -> Iterator[str]:
        start = 0
        while start < len(part):
            end = part.find(" ", start + READ)
            end = len(part) if end < 0 else end
            yield part[start:end]
            start = end + 1

    def unbroken(self, text: str) -> Iterator[str]:
        """Ids of a text without white space, in runs."""
        if len(text) <= READ:
            if run := self.run(text):
                yield run
            return
        text = self.normal(text)
        masked = text if text.isascii() else text.translate({ord(c): "\x01" for c in set(text) if unicodedata.category(c) == "Cn"})
        run: list[str] = []
        for m in regex.finditer(WORD_END, masked):
            word = text[m.start() : m.end()]
            if len(word) <= self.window:
                run.append(self.coded[word])
            else:
                for t in self.stream(word[i : i + self.window] for i in range(0, len(word), self.window)):
                    run.append(str(self.ids[t]))
                    if len(run) >= RUN:
                        yield " ".join(run)
                        run = []
            if len(run) >= RUN:
                yield " ".join(run)
                run = []
        if run:
            yield " ".join(run)

    def encode(self, text: str) -> str:
        return " ".join(self.pieces(text))


class Decoder:
    """Byte-to-text state machine: ids go in one by one or in runs, text comes out as soon as it is whole.

    as_tokens: each token's own spelling, joined by spaces, as a vocabulary file without a decoder is decoded by its
    library. Otherwise the bytes of the tokens as UTF-8, with a space for each word end; an incomplete character is held.
    """

    def __init__(self, codec: Codec, as_tokens: bool = True):
        self.codec, self.as_tokens, self.first, self.held = codec, as_tokens, True, b""
        self.bytes = {c: b for b, c in codec.names.items()}

    def feed(self, token: int) -> str:
        spelled = self.codec.tokens[token]
        if self.as_tokens:
            lead, self.first = "" if self.first else " ", False
            return lead + spelled
        if token in self.codec.special.values():
            return self.flush() + spelled
        ends = bool(self.codec.end) and spelled.endswith(self.codec.end)
        self.held += bytes(self.bytes[c] for c in (spelled[: -len(self.codec.end)] if ends else spelled))
        if ends:
            return self.flush() + " "
        for back in range(1, min(4, len(self.held)) + 1):
            lead = self.held[-back]
            if lead >= 0xC0:
                whole = back >= (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
                cut = len(self.held) if whole else len(self.held) - back
                break
            if lead < 0x80:
                cut = len(self.held)
                break
        else:
            cut = len(self.held)
        out, self.held = self.held[:cut].decode("utf-8", "replace"), self.held[cut:]
        return out

    def feed_run(self, run: list[int]) -> str:
        """What feeding the ids one after the other gives."""
        if not self.as_tokens or not run:
            return "".join(map(self.feed, run))
        lead, self.first = "" if self.first else " ", False
        return lead + " ".join(map(self.codec.tokens.__getitem__, run))

    def flush(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(text: Column, vocabulary: str) -> Column:
    """array<int> of ids, without begin or end tokens; null counts as empty: no ids."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(vocabulary)
        for texts in batches:
            yield pd.Series([[int(i) for i in c.encode(t).split()] if t else [] for t in texts])

    return ids(text)


def decode(ids: Column, vocabulary: str, as_tokens: bool = True) -> Column:
    """Text of an array of ids (null or no ids: empty); an id outside the vocabulary fails."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(vocabulary)
        for rows in batches:
            out = []
            for row in rows:
                d = Decoder(c, as_tokens)
                out.append(d.feed_run([int(i) for i in (row if row is not None else [])]) + d.flush())
            yield pd.Series(out, dtype="object")

    return text(ids)


def code_digests(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256: the ids of each run are hashed, decoded, and kept no longer.

    A null text counts as empty: no tokens, and both digests are those of the empty string. Rows keep their number.
    Texts leave the Arrow batch one by one, so that no second copy of the batch is made.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(vocabulary)
        for texts in batches:
            out = []
            for t in texts:
                ids, back, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, Decoder(c)
                for run in c.pieces(t.as_py() or ""):
                    ids.update((f" {run}" if n else run).encode())
                    got = list(map(int, run.split(" ")))
                    back.update(decoder.feed_run(got).encode())
                    n += len(got)
                back.update(decoder.flush().encode())
                out.append({"n_tokens": n, "ids_sha256": ids.hexdigest(), "decoded_sha256": back.hexdigest()})
            yield pa.array(out, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    name = free(df, "_coded")
    return df.withColumn(name, coded(F.col(text))).withColumns({k: F.col(f"{name}.{k}") for k in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop(name)
