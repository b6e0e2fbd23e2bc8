"""Quality rules on how well public vocabularies fit a text: characters per token, byte-fallback share, token entropy.

A vocabulary trained on real text spells real text with few, varied tokens. Noise, broken encodings and repeated
boilerplate leave those bands: too few or too many characters per token, too many tokens that are bytes, too little
variety. Bands are fixed for each script, so every text is judged by itself: no shuffle, and the same at every size. A
text is rejected only where every vocabulary finds it out of band.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points by script, first and last.
SCRIPTS: dict[str, list[tuple[int, int]]] = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x3040, 0x30FF), (0x20000, 0x2FA1F)],
}

#: (least and most characters per token, largest byte share, least entropy in bits, as a share of the most that so many tokens can have).
#: Wide on purpose: they bound what any text of the script can look like, not what is usual.
BANDS: dict[str, tuple[float, float, float, float]] = {
    "latin": (1.3, 12.0, 0.15, 0.25),
    "greek": (0.4, 8.0, 1.0, 0.2),
    "cyrillic": (0.6, 10.0, 0.5, 0.25),
    "hebrew": (0.3, 8.0, 1.0, 0.2),
    "arabic": (0.3, 8.0, 1.0, 0.2),
    "indic": (0.15, 8.0, 1.0, 0.2),
    "thai": (0.2, 8.0, 1.0, 0.2),
    "hangul": (0.2, 6.0, 1.0, 0.2),
    "han": (0.2, 6.0, 1.0, 0.2),
    "other": (0.1, 12.0, 0.6, 0.15),
}

#: Words that the base rules ask for, and repeated words in a hundred that they bear.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Characters of a word coded at a time, characters of texts judged together, and words whose ids a task remembers.
PIECE, AT_ONCE, KNOWN = 1 << 16, 2 << 20, 200_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")


@lru_cache(maxsize=8)
def vocabulary(path: str, pattern: str) -> tuple[Callable[[list[str]], list[list[int]]], np.ndarray]:
    """(ids of each word, whether an id is a byte or part of a character): a sentencepiece .model, or ranks of a .tiktoken by pattern.

    A word is coded as it is after a space.
    """
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        lone = np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(sp.get_piece_size())], dtype=bool)
        return (lambda words: sp.encode(words, num_threads=1)), lone
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    lone = np.zeros(max(ranks.values()) + 1, dtype=bool)
    for token, i in ranks.items():
        lone[i] = not _whole(token)
    return (lambda words: [coder.encode_ordinary(" " + w) for w in words]), lone


def _whole(token: bytes) -> bool:
    try:
        token.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


class Coded:
    """Words by number, and the ids of each in a vocabulary: a word is coded once, however many texts of a task hold it."""

    def __init__(self, paths: list[str], pattern: str):
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.of = [vocabulary(p, pattern) for p in paths]
        self.ids = [np.zeros(0, dtype=np.int32) for _ in paths]
        self.ends = [np.zeros(1, dtype=np.int64) for _ in paths]  # where the ids of word i end, at i + 1

    def code(self) -> None:
        """Code the words that have got a number since the last time; words of more than PIECE characters in pieces."""
        new = list(islice(self.number, len(self.ends[0]) - 1, None)) if self.of else []
        if not new:
            return
        for v, (code, _) in enumerate(self.of):
            got = code([w[:PIECE] for w in new])
            for i, w in enumerate(new):
                if len(w) > PIECE:
                    got[i] = list(chain(got[i], *code([w[k : k + PIECE] for k in range(PIECE, len(w), PIECE)])))
            length = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            self.ids[v] = np.concatenate([self.ids[v], np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(length.sum()))])
            self.ends[v] = np.concatenate([self.ends[v], self.ends[v][-1] + np.cumsum(length)])

    def measures(self, words: np.ndarray, chars: int, v: int) -> tuple[float | None, float | None, float | None]:
        """(characters of words per token, share of byte tokens, entropy of tokens in bits as a share of the most); None of no token.

        The most is log2 of the number of tokens, or of the vocabulary if that is smaller. A single token has all it can have.
        """
        lone, start = self.of[v][1], self.ends[v][words]
        length = self.ends[v][words + 1] - start
        tokens = int(length.sum())
        if not tokens:
            return None, None, None
        at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(tokens)
        ids, n = np.unique(self.ids[v][at], return_counts=True)
        p, most = n / tokens, np.log2(min(tokens, len(lone)))
        return chars / tokens, float(n[lone[ids]].sum() / tokens), float(-(p * np.log2(p)).sum() / most) if most else 1.0


def script_of(text: str) -> str:
    """The script of most letters; other where no listed script has any. Ties go to the first listed."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    best, name = 0, "other"
    for script, n in zip(SCRIPTS, np.bincount(_script_numbers()[np.minimum(points, _BEYOND)], minlength=len(SCRIPTS) + 1)[1:], strict=True):
        if n > best:
            best, name = n, script
    return name


_BEYOND = 0x30000


@lru_cache(maxsize=1)
def _script_numbers() -> np.ndarray:
    out = np.zeros(_BEYOND + 1, dtype=np.int8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            out[a : b + 1] = i + 1
    return out


def repeated_words(w: np.ndarray) -> int:
    """Words in windows of three that occur twice or more; w has a number for each word."""
    if len(w) < 4:
        return 0
    most = int(w.max()) + 1
    _, pair = np.unique(w[:-1] * most + w[1:], return_inverse=True)
    _, window, n = np.unique(pair[:-1] * most + w[2:], return_inverse=True, return_counts=True)
    again, covered = n[window] > 1, np.zeros(len(w), dtype=bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif _WORD.search(line):
            seen.add(line)
    return n


def in_band(measured: tuple[float | None, float | None, float | None], band: tuple[float, float, float, float]) -> bool:
    each, lone, entropy = measured
    return each is None or (band[0] <= each <= band[1] and lone <= band[2] and entropy >= band[3])


def judge(
    df: DataFrame, vocabularies: list[str], pattern: str, id: str = "doc_id", text: str = "text",
    bands: dict[str, tuple[float, float, float, float]] | None = None, least: int = LEAST_WORDS, repeated: int = MOST_REPEATED,
) -> DataFrame:
    """One row for each row of df: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, script,
    chars_per_token, byte_share, token_entropy (an entry for each vocabulary, null where the text has no token).

    The base rules fail texts of fewer than least words, and those with more than repeated in a hundred words in repeated
    windows; the bands of the text's script then decide. vocabularies are paths that executors can read. Null and empty
    texts have no words and fail. Repeated rows, null and repeated ids are judged each by itself; an empty table gives
    none. Other columns are ignored.
    """
    bands, read = bands or BANDS, [os.fspath(p) for p in vocabularies]

    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.list_(pa.float64())] * 3
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", "chars_per_token", "byte_share", "token_entropy"]

    def some(texts: list[str], words: Coded) -> list[tuple]:
        number, base = words.number, []
        for t in texts:
            found = _WORD.findall(t)
            w = np.fromiter(map(number.__getitem__, found), dtype=np.int64, count=len(found))
            base.append((w, len("".join(found)), len(_SYMBOL.findall(t)), repeated_lines(t), script_of(t)))
        words.code()
        out = []
        for w, chars, symbols, lines, script in base:
            again = repeated_words(w)
            got = [words.measures(w, chars, v) for v in range(len(read))]
            failed = len(w) < least or 100 * again > repeated * len(w)
            kept = not failed and (not got or any(in_band(m, bands[script]) for m in got))
            out.append((len(w), chars, symbols, lines, again, failed, kept, script, *([m[i] for m in got] for i in range(3))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Coded(read, pattern)
        for batch in batches:
            start = 0
            while start < len(batch):
                texts, size = [], 0
                while start + len(texts) < len(batch) and size < AT_ONCE:
                    texts.append(batch.column(1)[start + len(texts)].as_py() or "")
                    size += len(texts[-1])
                if len(words.number) > KNOWN:
                    words = Coded(read, pattern)
                out = zip(*some(texts, words), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], ["id", *names])
                start += len(texts)

    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    shape = ", ".join(f"{n} {'long' if k == pa.int64() else 'boolean' if k == pa.bool_() else 'string' if k == pa.string() else 'array<double>'}" for n, k in zip(names, kinds, strict=True))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {shape}").withColumnRenamed("id", id)
