"""Whitening, vocabulary fit and importance resampling, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lodestrata.llm import fertility, importance, whitening


def test_whitening(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r.normal(size=12) * np.arange(1, 13)], 1.0) for i in range(300)]
    rows += [(7, rows[7][1], 0.0), (None, rows[8][1], 0.0)]
    odd = [(400, None, 0.0), (401, [], 0.0), (402, [1.0] * 11 + [None], 0.0), (403, [1.0] * 11 + [math.nan], 0.0), (404, [math.inf] * 12, 0.0), (405, [1.0] * 5, 0.0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, x double")
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v, _ in rows])
    n, total = len(x), x.sum(axis=0)
    c = x - total / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    for block in (1, 8):
        got = whitening.whiten(df, block=block).collect()
        assert len(got) == 8 * n and {g.n for g in got} == {n}
        far = Counter((i, k + 1, int(d)) for (i, *_), d in zip(rows, ((n * x - total) ** 2).sum(axis=1), strict=True) for k in range(8))
        assert Counter((g.vec_id, g.component, int(g.deviation)) for g in got) == far
        y = dict(zip([i for i, *_ in rows], c @ v / np.sqrt(e), strict=True))
        for k in range(8):
            pairs = [(g.whitened, y[g.vec_id][k]) for g in got if g.component == k + 1]
            sign = math.copysign(1, pairs[0][0] * pairs[0][1])
            assert max(abs(a - sign * b) for a, b in pairs) < 1e-9
        assert all(g.explained == pytest.approx(e[g.component - 1] * n / (c**2).sum(), rel=1e-10) and g.identity_error < 1e-9 for g in got)
    flat = [(i, [float(i % 5), 2.0 * (i % 5), 1.0]) for i in range(40)]  # one direction has all the variance
    one = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<float>")).collect()
    assert len(one) == 40 and one[0].explained == pytest.approx(1)
    assert whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0])] * 3, "vec_id long, embedding array<float>")).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    wide = [(i, [1e9 * (i + 1), 0.0]) for i in range(3)]  # squares beyond 64 bits
    off = [(3 * int(1024 * v[0]) - 6 * 1024 * 10**9) ** 2 for _, v in wide]
    assert [int(g.deviation) for g in whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).orderBy("vec_id").collect()] == off


VOCABULARIES = [public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")]


def test_fertility(spark):
    rng = random.Random(5)
    prose = [" ".join(rng.choice("The a quick brown fox jumps over lazy dogs while seven wise judges quietly read old books near warm fires".split()) for _ in range(70)) for _ in range(3)]
    noise = " ".join("".join(chr(rng.randrange(0x2500, 0x2BFF)) for _ in range(12)) for _ in range(80))
    hexes = " ".join("%032x" % rng.getrandbits(128) for _ in range(80))
    loop = "buy now " * 60
    texts = [*prose, noise, hexes, loop, None, "", "few words", "a # b\na # b\n\n\n \na # b", prose[0] + "\n" + prose[0], "é" * 200_000 + " " + prose[1], prose[2]]
    df = spark.createDataFrame([(i if i else None, t, 4) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id or 0: r for r in fertility.judge(df, VOCABULARIES, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w, r = re.findall(r"[^\x20\x09-\x0D]+", t or ""), got[i]
        n, again, lines = Counter(zip(w, w[1:], w[2:])), set(), (t or "").split("\n")
        for k in range(len(w) - 2):
            if n[tuple(w[k : k + 3])] > 1:
                again |= {k, k + 1, k + 2}
        dup = sum(1 for k, x in enumerate(lines) if x.strip(" \t\r\x0b\f") and x in lines[:k])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
    assert got[0].kept and got[1].kept and got[2].kept and got[12].kept
    assert not got[3].kept and not got[3].base_failed and got[3].script == "other" and min(got[3].byte_share) > 0.6  # symbols of no vocabulary
    assert not any(got[i].kept for i in (5, 6, 7, 8, 9, 10))
    assert got[6].chars_per_token == [None, None]
    # by hand: one vocabulary, word by word
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=VOCABULARIES[0])
    ids = [x for w in prose[1].split() for x in sp.encode(w)]
    p = [c / len(ids) for c in Counter(ids).values()]
    assert got[1].chars_per_token[0] == pytest.approx(sum(map(len, prose[1].split())) / len(ids))
    assert got[1].token_entropy[0] == pytest.approx(-sum(x * math.log2(x) for x in p) / math.log2(len(ids)))
    assert fertility.judge(df.limit(0), VOCABULARIES, public_tokenizers.PATTERN).count() == 0


def features(t):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    return w, [zlib.crc32(x) % 10000 for x in w + [a + b" " + b for a, b in zip(w, w[1:])]]


def drawn(docs, target):
    n, t = Counter(), Counter()
    for _, x in docs:
        n.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    big_s, big_t = sum(n.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((n[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out, order = [], []
    for i, x in docs:
        w, f = features(x)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(w) >= 20:
            order.append(out[-1])
    order.sort(key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(order[: 25 * len(order) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_importance(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdeé0") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, "..."), (303, "ÀB cD-Ef\x00gh " * 30), (304, "x" * 5000 + " " + text(40)), (305, text(200_000)), (None, text(30)), (5, docs[5][1])]
    target = [text(40), None, "", "AB cd " * 20]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, score string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert sorted((tuple(r) for r in importance.resample(df, goal).collect()), key=str) == drawn(docs, target)
    assert importance.resample(df.limit(0), goal).count() == 0
    none = importance.resample(df, goal.limit(0)).count()
    assert none == len(docs)


def test_composed_checksums():
    words = [b"a", b"bc", b"d" * 600, b"\xc3\xa9", b"a"]
    found = importance.payloads(words)
    want = [zlib.crc32(w) % 10000 for w in words] + [zlib.crc32(a + b" " + b) % 10000 for a, b in zip(words, words[1:])]
    assert importance.buckets_of(found).tolist() == want
