import os

from pyspark.sql import functions as F

from lodestrata.operators import architecture as I
from lodestrata.operators import catalog as J
from lodestrata.operators import catalogs
from lodestrata.operators import embedding as E
from lodestrata.operators import search as S
from lodestrata.sources import corpus as C


def test_read_corpus(spark, tmp_path):
    os.makedirs(tmp_path / "a" / "b")
    (tmp_path / "a" / "x.ts").write_bytes(b"one\0")
    (tmp_path / "a" / "b" / "y.md").write_bytes(b"# y")
    got = {r.path.split("/a/")[-1]: (r.snapshot_id, bytes(r.content)) for r in C.read_corpus(spark, str(tmp_path), "s").collect()}
    assert got == {"x.ts": ("s", b"one\0"), "b/y.md": ("s", b"# y")}


def brute_components(paths):
    """The rules for source files, one by one: skip the shared directories, split the largest while it is large and groups stay few."""
    dirs = {p: p.split("/")[:-1] for p in paths}
    root = os.path.commonprefix([d for d in dirs.values()])
    groups, closed, first = {tuple(root): list(paths)}, set(), True
    while True:
        size = max((len(ps) for g, ps in groups.items() if g not in closed), default=0)
        big = sorted("/".join(g) for g, ps in groups.items() if g not in closed and len(ps) == size and (first or len(ps) > max(8, 0.35 * len(paths))))
        if not big:
            return {p: "/".join(g) or "(root)" for g, ps in groups.items() for p in ps}
        g = next(k for k in groups if "/".join(k) == big[0] and k not in closed)
        parts, own = {}, [p for p in groups[g] if len(dirs[p]) == len(g)]
        for p in groups[g]:
            if len(dirs[p]) > len(g):
                parts.setdefault(g + (dirs[p][len(g)],), []).append(p)
        first = False
        closed.add(g)
        if not parts or len(groups) - 1 + len(parts) + bool(own) > 12:
            continue
        del groups[g]
        groups |= parts
        if own:
            groups[g] = own


def test_group_components(spark):
    cases = {
        "flat": [f"src/f{i}.ts" for i in range(5)],
        "split": [f"src/{d}/{e}/f{i}.ts" for d in "abc" for e in "xy" for i in range(7)] + ["src/main.ts"],
        "wide": [f"lib/d{i}/f.ts" for i in range(20)] + ["lib/i.ts"],
        "deep": [f"a/b/c/{d}/f{i}.ts" for d, n in (("p", 30), ("q", 2)) for i in range(n)] + [f"a/b/c/p/in/g{i}.ts" for i in range(15)],
    }
    rows = [(s, p) for s, ps in cases.items() for p in ps] + [("split", "test/t.ts"), ("deep", "examples/e.ts")]
    got = {(r.snapshot_id, r.path): r.component for r in I.group_components(spark.createDataFrame(rows, "snapshot_id string, path string")).collect()}
    assert got["split", "test/t.ts"] == "(test)" and got["deep", "examples/e.ts"] == "(example)" and len(got) == len(rows)
    for s, ps in cases.items():
        want = brute_components(ps)
        assert {p: got[s, p] for p in ps} == want, s


def test_stack_and_catalogs(spark):
    manifests = spark.createDataFrame([("s", "package.json", '{"description": " Hi ", "dependencies": {"express": "1", "mine": "2"}}'), ("s", "a/package.json", '{"dependencies": {"express": "1", "redis": "1"}}'), ("t", "package.json", '{"devDependencies": {"typescript": "5"}}')], "snapshot_id string, path string, content string")
    files = spark.createDataFrame([("s", "x/a.js"), ("s", "b.mjs"), ("s", "deploy/Dockerfile.dev"), ("s", ".github/workflows/ci.yml"), ("t", "a.js"), ("t", "z/tsconfig.json")], "snapshot_id string, path string")
    d = I.declared_dependencies(manifests, "dependencies", "devDependencies", "peerDependencies")
    got = [(r.snapshot_id, r.name, r.evidence, r.position) for r in I.detect_stack(d, catalogs.stack_catalog(spark), files).orderBy("snapshot_id", "position").collect()]
    assert got == [("s", "JavaScript", "b.mjs", 1), ("s", "Express", "package.json", 2), ("s", "Redis", "a/package.json", 3), ("s", "Docker", "deploy/Dockerfile.dev", 4), ("s", "GitHub Actions", ".github/workflows/ci.yml", 5), ("t", "TypeScript", "package.json", 1)]
    assert [tuple(r) for r in I.package_description(manifests).collect()] == [("s", "Hi")]
    assert catalogs.integration_catalog(spark).select("name").distinct().count() == 55


def test_model_lines_are_those_of_the_match(spark):
    text = "// User is here\nmongoose.model('User', s);\nmongoose.model('User', s);\n"
    got = I.detect_data_models(spark.createDataFrame([("s", "a.ts", text), ("s", "b.prisma", "// model X\n\nmodel User {\n}\n")], "snapshot_id string, path string, content string"))
    assert sorted((r.path, r.source, r.name, r.line) for r in got.collect()) == [("a.ts", "mongoose", "User", 2), ("a.ts", "mongoose", "User", 3), ("b.prisma", "prisma", "User", 3)]


def test_limits(spark):
    df = spark.createDataFrame([("s", "CODE", None, "abc"), ("s", "CODE", "binary", "x" * 500), ("t", "CODE", None, "a"), ("t", "CODE", None, "b")], "snapshot_id string, kind string, skip string, content string")
    chunks = spark.createDataFrame([("t",)] * 3, "snapshot_id string")
    of = lambda **k: {r.snapshot_id: r.problem for r in C.check_limits(df, k, chunks=chunks).collect()}
    assert of(total_bytes=30, unpacked=10) == {"s": "unpacks-too-large", "t": None}
    assert of(chunks=2) == {"s": None, "t": "too-many-chunks"} and of(code_files=1) == {"s": None, "t": "too-many-files"}


def test_visible_snapshots(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    asked = t([("a", 1), ("b", 1), ("b", 2), ("a", 9), ("a", 1)], "viewer string, snapshot_id long")
    got = J.visible_snapshots(asked, t([(1, 10), (2, 20)], "snapshot_id long, repo long"), t([("a", 10)], "user string, repo long"), t([(20,)], "repo long"))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 2)]


def test_vector_search_in_blocks(spark, monkeypatch):
    """Blocks of any size give the same lists; ties go by id, zero vectors and other snapshots or models are no neighbours."""
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(i, f"s{i % 2}", "m" if i % 7 else "n", [float(x) for x in r.integers(-3, 4, 5)]) for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, snapshot_id string, model string, embedding array<double>")
    queries = chunks.filter("chunk_id % 20 = 1").select(F.col("chunk_id").alias("query_id"), "snapshot_id", "model", F.col("embedding").alias("vector"))
    want = set()
    for q, s, m, v in rows:
        if q % 20 == 1 and any(v):
            near = [(-round(float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), 9), i) for i, s2, m2, w in rows if (s2, m2) == (s, m) and any(w)]
            want |= {(q, i, k + 1) for k, (_, i) in enumerate(sorted(near)[:6])}
    for block in (4096, 40):
        monkeypatch.setattr(S, "BLOCK", block)
        assert {(x.query_id, x.chunk_id, x["rank"]) for x in S.vector_search(queries, chunks, 6).collect()} == want
    assert S.vector_search(queries.limit(0), chunks, 6).count() == 0


def test_embedding_jobs(spark):
    df = spark.createDataFrame([(1, [1.0], "m1", "a"), (2, None, None, "b"), (3, [1.0], "m0", None)], "chunk_id long, embedding array<float>, embedding_model string, text string")
    assert {r.chunk_id for r in E.embed_missing(df, E.unit_sum, "m1").collect()} == {2, 3}
    v = {r.i: r.embedding for r in E.hash_embed(spark.createDataFrame([(1, "a A b"), (2, "!!"), (3, None)], "i long, t string"), "i", "t", 16).collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-6 and not any(v[2]) and not any(v[3])


def test_questions_name_their_lines(spark, tmp_path):
    good = '{"id": "q-1", "repo": "a/b", "question": "where is it made?", "gold": ["x.ts"]}'
    (tmp_path / "q.jsonl").write_text(f"{good}\n\n" + good.replace("q-1", "q-2").replace("where is it made?", "short") + "\nnot json\n" + good.replace("q-1", "q-3").replace("a/b", "c/d") + "\n")
    got = {r.line: r.problem for r in C.read_questions(spark, str(tmp_path / "q.jsonl"), ["a/b"]).collect()}
    assert got == {1: None, 3: "short question", 4: "bad id", 5: "unknown repository"}


def test_nearest_config_of_a_folder(spark):
    from lodestrata.operators import resolve as R

    configs = spark.createDataFrame([("s", f"p/{n}.json", "p", b, None, None) for n, b in (("tsconfig", "p/one"), ("tsconfig.build", "p/two"), ("jsconfig", "p/three"))], "snapshot_id string, path string, folder string, base string, aliases map<string,array<string>>, alias_folder string")
    files = spark.createDataFrame([("s", f"p/{d}/m.ts") for d in ("one", "two", "three")], "snapshot_id string, path string")
    asked = spark.createDataFrame([(1, "s", "p/q/a.ts", "m")], "import_id long, snapshot_id string, path string, specifier string")
    assert [tuple(r) for r in R.resolve_alias(asked, configs, files).collect()] == [(1, "p/one/m.ts")]
