from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.sources import corpus as C


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_identifiers(spark):
    assert one(spark, "getUserByID", T.split_identifier) == ["get", "user", "by", "id"]
    assert one(spark, "MAX_FILE_KB", T.split_identifier) == ["max", "file", "kb"]
    assert one(spark, "HTMLParser2x", T.split_identifier) == ["html", "parser2x"]
    assert one(spark, "where do we createUser?", T.query_terms) == ["createuser", "create", "user"]
    assert one(spark, "the of", T.query_terms) == []
    assert one(spark, "Find getId in App.run", T.query_identifiers) == ["find", "getid", "app", "run"]


def test_roles(spark):
    cases = {"src/a.ts": "source", "test/a.ts": "test", "src/a.spec.tsx": "test", "examples/x/a.js": "example", "vite.config.ts": "tooling", "scripts/a.js": "tooling", "lib/config.js": "source", "my/demo.ts": "source"}
    for path, role in cases.items():
        assert one(spark, path, T.classify_role) == role
    assert one(spark, "test/a.ts", T.is_test_file) and not one(spark, "test/helpers.ts", T.is_test_file)
    assert one(spark, "tests/a.ts", T.is_supporting) and not one(spark, "app/test/route.ts", T.is_supporting)


def test_paths(spark):
    for bad in ("../a", "/a", "a\\b", "C:/a", "", "./.", "a/../b"):
        assert one(spark, bad, C.safe_path) is None
    assert one(spark, "./a//b/./c", C.safe_path) == "a/b/c"
    assert one(spark, "top/a/b", lambda c: C.safe_path(c, True)) == "a/b"
    for path, want in {"a/package.json": ("CONFIG", "json", None), "node_modules/x.ts": (None, None, "ignored-directory"), "yarn.lock": (None, None, "lockfile"), "a.min.js": (None, None, "minified"), "a.d.ts": ("CODE", "typescript", None), "README": ("DOC", "text", None), "docs/a.rst": ("DOC", "text", None), "x/docs/a.rst": (None, None, "unsupported-type"), "docker-compose.dev.yml": ("CONFIG", "yaml", None), ".env.sample": ("CONFIG", "text", None)}.items():
        got = one(spark, path, C.path_class)
        assert (got.kind, got.language, got.skip) == want


def test_content(spark):
    df = spark.createDataFrame([("a\0b", "CODE"), ("// @generated\n", "CODE"), ("x\n" * 6 + "do not edit", "CODE"), ("y" * 5001, "CODE"), ("y" * 5001, "DOC"), ("a\nb", "CODE")], "content string, kind string")
    assert [r.p for r in df.select(C.content_problem(F.col("content"), F.col("kind")).alias("p")).collect()] == ["binary", "generated", None, "minified", None, None]
    meta = C.file_metadata(spark.createDataFrame([("a\n",), ("",)], "content string")).collect()
    assert [(m.line_count, m.size_bytes) for m in meta] == [(2, 2), (0, 0)]


def test_repo_refs(spark):
    for value, want in {"https://github.com/a/b": ("a", "b", None), "a/b.git": ("a", "b", None), "github.com/a/b/tree/x/y": ("a", "b", "x/y"), "https://www.github.com/a/b/": ("a", "b", None)}.items():
        got = one(spark, value, T.parse_repo_ref)
        assert (got.owner, got.repo, got.ref) == want
    for bad in ("https://evil.com/a/b", "https://github.com:80/a/b", "https://u@github.com/a/b", "a", "", "https://github.com/a/b/issues/1", "-a/b", "a/.."):
        assert one(spark, bad, T.parse_repo_ref) is None


def test_jsonc(spark):
    assert one(spark, '{"a": "//x, ]", /* c */ "b": [1, 2,], // end\n}', T.clean_jsonc).replace(" ", "").replace("\n", "") == '{"a":"//x,]","b":[1,2]}'
    assert one(spark, "{", T.clean_jsonc) is None


def test_citations(spark):
    got = one(spark, "A [1, 9] and [9] .  B [2][1].", lambda c: T.check_citations(c, F.lit(3)))
    assert (got.valid, got.invalid, got.cleaned, got.flagged) == ([1, 2], [9], "A [1] and. B [2][1].", True)
    got = one(spark, "x  [1] y", lambda c: T.check_citations(c, F.lit(3)))
    assert got.cleaned == "x  [1] y" and not got.flagged
    assert one(spark, "no markers", lambda c: T.check_citations(c, F.lit(3))).cleaned == "no markers"


def test_snippet_and_lines(spark):
    assert one(spark, "\n    a  \n\n      b\n    c\n d\ne", T.snippet) == "   a\n     b\n   c\nd"
    assert len(one(spark, "z" * 400, T.snippet)) == 301
    lines = [r.line for r in C.explode_lines(spark.createDataFrame([("a\nb\n",)], "content string")).orderBy("line_no").collect()]
    assert lines == ["a", "b", ""]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "snapshot_id string, x int")
    for _ in range(2):
        C.write_snapshot(df, f"file://{tmp_path}/t")
    C.write_snapshot(spark.createDataFrame([("s1", 7)], "snapshot_id string, x int"), f"file://{tmp_path}/t")
    assert sorted((r.snapshot_id, r.x) for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [("s1", 7), ("s2", 2)]
    assert C.append_new(df, df.filter("x = 1"), "x").count() == 1
    (tmp_path / "q.jsonl").write_text('{"id": "q-1", "repo": "a/b", "question": "where is it?", "gold": ["x.ts"]}\n{"id": "Q", "repo": "a/b"}\n\n')
    assert [r.problem for r in C.read_questions(spark, f"file://{tmp_path}/q.jsonl", ["a/b"]).orderBy("line").collect()] == [None, "bad id"]
