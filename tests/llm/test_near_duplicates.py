import random
import re

import numpy as np
import xxhash

from lodestrata.llm import simhash
from lodestrata.llm.components import components
from lodestrata.llm.grid_join import linked_vectors


def least(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(1, 60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(150)] + [(7, 7), (500, 2)] + [(900, 900 + k) for k in range(50)]
    ids = {x for e in links for x in e}
    got = {x.node: x.component for x in components(spark.createDataFrame(links + links[:9], "a long, b long")).collect()}
    want = least(ids, links)
    assert got == {i: c for i, c in want.items() if i != c}
    assert components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0


def test_masks_cover():
    for radius in (1, 2, 3):
        masks = [m & (2**64 - 1) for m in simhash.masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        r = random.Random(radius)
        for _ in range(3000):
            diff = sum(1 << i for i in r.sample(range(64), r.randint(0, radius)))
            assert any(not m & diff for m in masks)


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark, monkeypatch):
    r = random.Random(1)
    words = ["w%d" % i for i in range(300)]
    texts = [None, "", " \n", "ONE", "one two", "É É é  x", "a\x85b c"]
    base = [r.choice(words) for _ in range(400)]
    for _ in range(120):  # near copies: some words changed
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(400)] = r.choice(words)
        texts.append(" ".join(t))
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(60)] + [texts[10]] * 3
    rows = [(i * 3 + 5, t, 1) for i, t in enumerate(texts)]
    r.shuffle(rows)
    prints = {i: brute_print(t) for i, t, _ in rows}
    ids = sorted(prints)
    want = least(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    for pairwise in (32, 2):  # the second sends nearly all buckets through shared neighbours
        monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
        got = simhash.near_duplicates(df).collect()
        assert len(got) == len(rows)
        assert {x.doc_id: int(x.fingerprint, 16) for x in got} == prints
        assert {x.doc_id: x.component_id for x in got} == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert {x.component_id for x in simhash.near_duplicates(spark.createDataFrame([(4, "q"), (None, "q"), (4, "q")], "doc_id long, text string")).collect()} == {4}


def test_radius_one_and_three(spark):
    r = random.Random(9)
    prints = {0} | {sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 3, 4) for _ in range(60)}
    fps = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    for radius in (1, 3):
        want = least(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= radius])
        got = {x.node: x.component for x in components(simhash.links(nodes, radius)).collect()}
        assert got == {i: c for i, c in want.items() if i != c}


def test_linked_vectors(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 8))
    rows = []
    for i in range(400):
        v = base[i % 40] + r.normal(size=8) * r.choice([0.02, 0.2, 0.6])
        rows.append((i * 2 + 1, [float(x) for x in v], i))
    rows += [(2000 + i, [float(x) for x in base[0]], 0) for i in range(30)] + [(3000, [float(2 * x) for x in base[0]], 0)]
    odd = [(4000, None, 0), (4001, [], 0), (4002, [0.0] * 8, 0), (4003, [float("nan")] * 8, 0), (4004, [1.0, None] * 4, 0), (4005, [float("inf")] + [1.0] * 7, 0), (4006, [1.0] * 5, 0), (4007, [2.0] * 5, 0), (4008, [1.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, kept int")
    got = {x.vec_id: x for x in linked_vectors(df).collect()}
    m = np.array([v for _, v, _ in rows])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    ids = [i for i, _, _ in rows]
    want = least(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit), strict=True)])
    for k, i in enumerate(ids):
        assert got[i].n_links == hit[k].sum() and got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    for i in (4000, 4001, 4002, 4003, 4004, 4005, 4008):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[4007].component_id == 4006 and got[4006].n_links == 1
    assert linked_vectors(df.limit(0)).count() == 0


def test_many_intervals(spark, monkeypatch):
    from lodestrata.llm import grid_join

    monkeypatch.setattr(grid_join, "INTERVAL", 16)
    monkeypatch.setattr(grid_join, "FANOUT", 3)
    monkeypatch.setattr(grid_join, "PART", 5)
    r = np.random.default_rng(4)
    m = r.normal(size=(300, 3))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = {x.vec_id: x.n_links for x in linked_vectors(df, cosine=0.98).collect()}
    f = m.astype("float32").astype(float)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    hit = u @ u.T >= 0.98
    assert got == {i: int(hit[i].sum()) - 1 for i in range(300)}


def test_bounds_leave_out_distant_pairs(spark):
    """Parts are skipped where vectors form clusters, single pairs wherever sketches are far apart; no linked pair ever is."""
    from lodestrata.llm import grid_join

    r = np.random.default_rng(6)
    spread = r.normal(size=(3000, 32))
    tight = r.normal(size=(30, 32))[r.integers(0, 30, 3000)] + 0.05 * r.normal(size=(3000, 32))
    for x, parts_at_least in ((tight, 0.5), (spread, 0.0)):
        u = grid_join.units_of(x)
        axes = np.linalg.svd(x, full_matrices=False)[2][: grid_join.SKETCH_DIMS]
        p = u @ axes.T
        s = np.hstack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(1, keepdims=True)))]).astype("<f4")
        s = s[np.lexsort(np.floor(p[:, :8] / (np.sqrt(0.1) / grid_join.FINE)).T[::-1])]
        lo, hi = grid_join._boxes(s)
        gap = (np.maximum(np.maximum(lo[:, None] - hi[None], lo[None] - hi[:, None]), 0) ** 2).sum(2)
        assert (gap > 0.1 + grid_join.SLACK).mean() >= parts_at_least
        may, linked = s @ s.T >= 0.95 - grid_join.SLACK, None
        order = np.lexsort(np.floor(p[:, :8] / (np.sqrt(0.1) / grid_join.FINE)).T[::-1])
        linked = u[order] @ u[order].T >= 0.95
        assert not (linked & ~may).any() and (~may).mean() >= 0.95
