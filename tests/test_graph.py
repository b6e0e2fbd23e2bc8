import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import architecture as I
from lodestrata.operators import chunking as D
from lodestrata.operators import evaluation as K
from lodestrata.operators import graph as H
from lodestrata.operators.architecture import route_weight
from lodestrata.operators import search as S
from lodestrata.sources.shared import store


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    return {n: c for n in nodes if (c := min(m for m in nodes if m in reach[n] and n in reach[m])) != n or any(m != n and m in reach[n] and n in reach[m] for m in nodes)}


def test_import_cycles(spark):
    r = random.Random(4)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(200 + i, 200 + (i + 1) % 25) for i in range(25)] + [(300, 301), (301, 300), (301, 302), (302, 301), (5, 5)]
    got = {x.node: x.component for x in H.import_cycles(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])
    assert H.import_cycles(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_cycle_loops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (7, 8), (8, 7)], "a long, b long")
    got = {x.component: x.loop for x in H.cycle_loops(H.import_cycles(edges), edges).collect()}
    assert got == {1: [1, 2, 1], 7: [7, 8, 7]}


SYMBOLS = "symbol_id long, snapshot_id string, path string, kind string, name string, parent_id long, start_line int, end_line int"
CALLS = "from_symbol_id long, to_symbol_id long, snapshot_id string, path string, line int, callee_text string, resolved boolean"
ROUTES = "route_id long, handler_symbol_id long, method string, url_path string, snapshot_id string, path string, start_line int, end_line int"


def test_impact_and_chains(spark):
    symbols = spark.createDataFrame([(i, "s", "test/a.ts" if i == 5 else "src/a.ts", "class" if i == 1 else "function", f"n{i}", 1 if i == 8 else None, i * 10, i * 10 + 5) for i in range(1, 10)], SYMBOLS)
    rows = [(2, 1, "src/a.ts", 21, True), (3, 2, "src/a.ts", 31, True), (4, 2, "src/a.ts", 41, True), (5, 4, "test/a.ts", 51, True), (6, 5, "src/a.ts", 61, True), (9, 1, "src/a.ts", 91, False), (7, 8, "src/a.ts", 71, True), (None, 3, "src/b.ts", 4, True), (None, 2, "src/c.ts", 9, True), (None, 4, "test/z.ts", 1, True)]
    calls = spark.createDataFrame([(a, b, "s", p, line, "x", ok) for a, b, p, line, ok in rows], CALLS)
    routes = spark.createDataFrame([(70, None, "GET", "/b", "s", "src/b.ts", 1, 5), (71, None, "GET", "/other", "t", "src/c.ts", 1, 50), (72, 4, "GET", "/a", "s", "src/a.ts", 1, 2)], ROUTES)
    got = H.impact(spark.createDataFrame([(1,)], "target_id long"), symbols, calls, routes)
    assert {(r.symbol_id, r.depth, r.parent_id) for r in got.filter("kind = 'symbol'").collect()} == {(1, 0, None), (8, 0, None), (2, 1, 1), (7, 1, 8), (3, 2, 2), (4, 2, 2)}
    assert {(r.kind, r.route_id, r.path, r.depth) for r in got.filter("kind <> 'symbol'").collect()} == {("test", None, "test/a.ts", 3), ("test", None, "test/z.ts", 3), ("route", 70, None, 3), ("module", None, "src/c.ts", 2)}
    chains = H.impact_chains(got, spark.createDataFrame([(4,)], "symbol_id long"))
    assert [r.chain for r in chains.collect()] == [[4, 2, 1]]
    lists = {(r.list, r.item, r.path, r.depth) for r in H.impact_lists(got, symbols, routes).collect()}
    assert {("routes", "72", None, 2), ("routes", "70", None, 3), ("tests", None, "test/a.ts", 3), ("dependents", "top-level code", "src/c.ts", 2), ("dependents", "route 70", "src/b.ts", 3)} <= lists
    assert [(r.path, r.n) for r in H.impact_by_file(got, symbols).collect()] == [("src/a.ts", 4)]


def test_impact_stores_what_it_finds_and_not_each_call_to_it(spark, monkeypatch):
    n, rows = 12, []
    monkeypatch.setattr(H, "store", lambda df, name: (got := store(df, name), rows.append(got.count()))[0])
    symbols = spark.createDataFrame([(i, "s", "a.ts", "function", "f", None, i, i) for i in range(n)], SYMBOLS)
    calls = spark.createDataFrame([(a, b, "s", "a.ts", a * 100 + b, "f", True) for a in range(n) for b in range(n) if a != b], CALLS)
    got = H.impact(spark.createDataFrame([(i,) for i in range(n)], "target_id long"), symbols, calls, spark.createDataFrame([], ROUTES))
    assert {(r.target_id, r.symbol_id, r.depth, r.parent_id, r.line) for r in got.collect()} == {(t, s, int(t != s), t if t != s else None, s * 100 + t if t != s else None) for t in range(n) for s in range(n)}
    assert sum(rows) <= 3 * (n * n + calls.count())


def test_a_long_chain_of_callers(spark):
    n = 40
    symbols = spark.createDataFrame([(i, "s", "a.ts", "function", "f", None, i, i) for i in range(n)], SYMBOLS)
    calls = spark.createDataFrame([(i + 1, i, "s", "a.ts", i + 1, "f", True) for i in range(n - 1)], CALLS)
    got = H.impact(spark.createDataFrame([(0,)], "target_id long"), symbols, calls, spark.createDataFrame([], ROUTES))
    assert {(r.symbol_id, r.depth) for r in got.collect()} == {(i, i) for i in range(n)}
    assert H.impact_chains(got, spark.createDataFrame([(n - 1,)], "symbol_id long")).first().chain == [*range(n - 1, -1, -1)]


def test_snapshots_stay_apart(spark):
    """Two snapshots with the same paths: nothing of one is found in the other."""
    symbols = spark.createDataFrame([(1, "s", "a.ts", "function", "f", None, 1, 9), (2, "t", "a.ts", "function", "f", None, 2, 5)], SYMBOLS)
    calls = spark.createDataFrame([(1, 1, "s", "a.ts", 3, "one", True), (2, 2, "t", "a.ts", 3, "two", True), (None, 2, "t", "a.ts", 8, "three", True)], CALLS)
    routes = spark.createDataFrame([(5, None, "GET", "/", "s", "a.ts", 7, 9), (6, 1, "GET", "/", "s", "a.ts", 1, 9)], ROUTES)
    points = spark.createDataFrame([(1, "s", "a.ts", 3), (2, "t", "a.ts", 3), (3, "u", "a.ts", 3)], "point_id long, snapshot_id string, path string, line int")
    assert {r.point_id: r.symbol_id for r in H.symbol_at(points, symbols).collect()} == {1: 1, 2: 2, 3: None}
    both = spark.createDataFrame([(1,), (2,)], "symbol_id long")
    assert {(r.symbol_id, r.callee_text) for r in H.callees(both, symbols, calls).collect()} == {(1, "one"), (2, "two")}
    assert {(r.symbol_id, r.line, r.route_id) for r in H.callers(both, calls, routes).collect()} == {(1, 3, None), (2, 3, None), (2, 8, None)}
    assert {(r.route_id, r.callee_text) for r in H.trace_routes(routes, symbols, calls)[1].collect()} == {(6, "one")}
    assert {r.route_id: r.weight for r in route_weight(routes, calls).collect()} == {5: 0, 6: 1}


def test_trace(spark):
    routes = spark.createDataFrame([(1, 10, "GET", "/", "s", "a", 1, 1), (2, None, "GET", "/i", "s", "c", 4, 6)], ROUTES)
    symbols = spark.createDataFrame([(10, "s", "a", "function", "h", None, 1, 5), (11, "s", "a", "function", "g", None, 6, 8), (12, "s", "b", "class", "K", None, 1, 9), (13, "s", "b", "method", "constructor", 12, 2, 3), (14, "s", "b", "class", "E", None, 20, 30)], SYMBOLS)
    rows = [("a", 2, "x", 11), ("a", 3, "y", None), ("a", 7, "z", 12), ("b", 2, "back", 10), ("b", 7, "unseen", 11), ("c", 4, "app.get", 11), ("c", 5, "app.get", 14), ("c", 6, "own", 10), ("b", 25, "never", 10)]
    calls = spark.createDataFrame([(None, b, "s", p, line, t, b is not None) for p, line, t, b in rows], CALLS)
    nodes, made = H.trace_routes(routes, symbols, calls)
    assert {(r.symbol_id, r.depth, r.parent_id) for r in nodes.filter("route_id = 1").collect()} == {(10, 0, None), (11, 1, 10), (12, 2, 11)}
    assert {(r.symbol_id, r.line, r.callee_text) for r in made.filter("route_id = 1").collect()} == {(10, 2, "x"), (10, 3, "y"), (11, 7, "z"), (12, 2, "back")}
    assert {(r.symbol_id, r.depth) for r in nodes.filter("route_id = 2").collect()} == {(None, 0), (14, 1), (10, 1), (11, 2), (12, 3)}
    assert not made.filter("route_id = 2 and (line = 4 or callee_text = 'never')").count()
    assert {(r.symbol_id, r.n) for r in H.trace_tree(nodes, made).filter("route_id = 1").collect()} == {(11, 1), (12, 1)}
    few, calls_made = H.trace_routes(routes.filter("route_id = 1"), symbols, calls, nodes=2, per_node=1)
    assert few.count() == 2 and calls_made.filter("symbol_id = 10").first().truncated


def test_fusion_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, 5, 1, ["f"]), (1, 6, 2, ["f"])], "query_id long, chunk_id long, rank int, sources array<string>")
    b = spark.createDataFrame([(1, 6, 1, ["v"]), (1, 7, 2, ["v"])], "query_id long, chunk_id long, rank int, sources array<string>")
    x, y = (sorted(map(tuple, S.rrf(*p).collect())) for p in ((a, b), (b, a)))
    assert x == y and [r for r in x if r[1] == 6][0][2] == pytest.approx(1 / 61 + 1 / 62)


def test_fuzzy(spark):
    files = spark.createDataFrame([("s", p) for p in ("src/user/controller.ts", "src/uc.ts", "lib/other.ts")], "snapshot_id string, path string")
    q = spark.createDataFrame([(1, "s", "uc"), (2, "s", "zzz"), (3, "s", "")], "query_id long, snapshot_id string, text string")
    got = [(r.query_id, r.path) for r in S.fuzzy_paths(q, files).orderBy("rank").collect()]
    assert got[0] == (1, "src/uc.ts") and all(i == 1 for i, _ in got)


def test_fuzzy_places_each_text_once(spark, monkeypatch):
    """Queries of one text in one snapshot are placed once, and each gets all the hits; a query given twice gets them once."""
    files = spark.createDataFrame([(s, f"src/u{i}/c{i}.ts") for s in "st" for i in range(12)], "snapshot_id string, path string")
    texts, stored = [(i, "st"[i % 2], "uc" if i % 3 else "U C") for i in range(30)], {}
    keep = lambda df, name: stored.setdefault(name, store(df, name))
    monkeypatch.setattr(S, "store", keep)
    got = S.fuzzy_paths(spark.createDataFrame(texts + texts[:1], "query_id long, snapshot_id string, text string"), files, 5).collect()
    assert stored["path-texts"].count() == 2 and stored["path-hits"].count() == 10
    assert len(got) == 150 and len({(r.query_id, r.rank) for r in got}) == 150
    assert len({tuple((r.path, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == i) for i in range(30)}) == 1


def test_approximate_recall(spark):
    rows = [(i, "s", "m", [float((i * p) % 101) - 50 for p in (3, 7, 11, 13)]) for i in range(1, 200)]
    c = spark.createDataFrame(rows, "chunk_id long, snapshot_id string, model string, embedding array<float>")
    q = c.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "snapshot_id", "model", F.col("embedding").alias("vector"))
    exact = {(r.query_id, r.chunk_id) for r in S.vector_search(q, c, 5).collect()}
    near = {(r.query_id, r.chunk_id) for r in S.approximate_vector_search(q, c, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_approximate_recall_as_registered(spark):
    """64 dimensions and k = 30, as f6 runs: unit vectors far from one another, and a group of fewer than k."""
    r = np.random.default_rng(6)
    rows = [(i, "01"[i % 2], "m1", [float(x) for x in r.normal(size=64)]) for i in range(1, 801)] + [(900 + i, "few", "m1", [float(x) for x in r.normal(size=64)]) for i in range(20)]
    c = spark.createDataFrame(rows, "chunk_id long, snapshot_id string, model string, embedding array<float>")
    q = c.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "snapshot_id", "model", F.col("embedding").alias("vector"))
    exact = {(x.query_id, x.chunk_id) for x in S.vector_search(q, c).collect()}
    near = {(x.query_id, x.chunk_id) for x in S.approximate_vector_search(q, c).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    narrow = {(x.query_id, x.chunk_id): x.score for x in S.approximate_vector_search(q, c, bucket=1e-6, tables=1).collect()}
    assert set(narrow) == exact  # where hardly any meet, lists are filled by the exact search


def test_odd_vectors(spark):
    """Zero vectors, other lengths and other snapshots are nobody's neighbours, and a table can be searched for its own rows."""
    rows = [(i, s, "m", [float(i), 1.0, float(-i % 7)]) for s, at in (("a", 0), ("b", 100)) for i in range(at + 1, at + 41)]
    rows += [(200, "a", "m", [0.0, 0.0, 0.0]), (201, "a", "m", [1.0, 2.0]), (202, "a", "m", None), (203, "c", "m", [1.0, 0.0, 0.0])]
    c = spark.createDataFrame(rows, "chunk_id long, snapshot_id string, model string, embedding array<float>")
    q = c.select(F.col("chunk_id").alias("query_id"), "snapshot_id", "model", F.col("embedding").alias("vector"))
    exact = {(r.query_id, r.chunk_id) for r in S.vector_search(q, c, 4).collect()}
    near = {(r.query_id, r.chunk_id) for r in S.approximate_vector_search(q, c, 4).collect()}
    of = {i: (s, len(v)) for i, s, _, v in rows if v and any(v)}
    for pairs in (exact, near):
        assert all(of[a] == of[b] for a, b in pairs) and {(201, 201), (203, 203)} <= pairs and {a for a, _ in pairs} == set(of)
    assert len(exact & near) >= 0.9 * len(exact)
    assert S.approximate_vector_search(q, c.limit(0)).count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([("r", 1, "a", 1), ("r", 1, "x", 2), ("r", 1, "b", 3)], "retriever string, question_id long, path string, rank int")
    q = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, ["z"])], "question_id long, gold array<string>")
    got = {r.question_id: r for r in K.score_questions(ranked, q, ranked).collect()}
    assert got[1].recall_5 == pytest.approx(2 / 3) and got[1].mrr == 1 and got[2].recall_10 == 0 and got[3].ndcg_10 == 0
    assert got[1].ndcg_10 == pytest.approx((1 + 0.5) / (1 + 0.63092975 + 0.5), abs=1e-6)


def test_sections(spark):
    text = "# A\nintro\n```\n# no\n```\n## B ##\n\n# C\nlast"
    lines = spark.createDataFrame([("s", "p", i + 1, t) for i, t in enumerate(text.split("\n"))], "snapshot_id string, path string, line_no int, line string")
    got = [(r.label, r.start_line, r.end_line) for r in D.doc_sections(lines).orderBy("start_line").collect()]
    assert got == [("A", 1, 5), ("C", 8, 9)]


def test_groups(spark):
    paths = [f"src/api/{d}/f{i}.ts" for d in ("a", "b", "c") for i in range(8)] + ["src/web/x.ts", "test/t.ts", "src/main.ts"]
    got = I.group_components(spark.createDataFrame([("s", p) for p in paths], "snapshot_id string, path string"))
    sizes = {r.component: r["count"] for r in got.groupBy("component").count().collect()}
    assert sizes["(test)"] == 1 and sizes["src/api/a"] == 8 and sizes["src/web"] == 1
