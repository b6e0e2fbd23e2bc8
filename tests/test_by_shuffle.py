"""Tables that grow with the input are no broadcasts, however few their bytes seem to be."""

from lodestrata.operators import facts as B
from lodestrata.operators import resolve as C
from lodestrata.plans import code as P


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def parts(spark, tmp_path) -> str:
    spark.range(1, 61).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_texts_of_routes_are_no_broadcasts(spark, tmp_path):
    got = B.extract_routes(P.files(spark, parts(spark, tmp_path)))
    assert "Broadcast" not in plan(got) and "SortMergeJoin" in plan(got)
    assert got.count() == 12 * 11  # twelve files of each form


def test_exports_and_calls_are_resolved_by_shuffle(spark):
    table = lambda cols, *rows: spark.createDataFrame(rows, cols)
    symbols = table(
        "snapshot_id string, path string, symbol_id string, kind string, name string, start_line int, exported boolean, exported_as string, parent_id string, container string",
        ("s", "a.ts", "a:f", "function", "f", 1, True, "f", None, None), ("s", "b.ts", "b:C", "class", "C", 1, True, "C", None, None), ("s", "b.ts", "b:C.m", "method", "m", 2, True, None, "b:C", None),
    )
    files = table("snapshot_id string, path string", ("s", "a.ts"), ("s", "b.ts"))
    asked = table("import_id string, snapshot_id string, path string, specifier string", ("i", "s", "b.ts", "./a"))
    found = C.resolve_relative(asked, files)
    exports = C.resolve_exports(table("snapshot_id string, path string, name string", ("s", "b.ts", "f")), symbols, table("snapshot_id string, path string, n int, imported string, exported string, to_path string", ("s", "b.ts", 1, "*", "*", "a.ts")))
    calls = table("call_id string, snapshot_id string, path string, receiver string, callee_name string, from_symbol_id string", ("1", "s", "b.ts", "this", "m", "b:C.m"), ("2", "s", "b.ts", "this", "m", None), ("3", "s", "b.ts", None, "C", None))
    resolved = C.resolve_calls(calls, table("snapshot_id string, path string, local string, to_path string, imported string", ("s", "b.ts", "g", "a.ts", "f")), symbols, exports)
    for df in (found, exports, resolved):
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)
    assert [tuple(r) for r in found.collect()] == [("i", "a.ts")] and [r.symbol_id for r in exports.collect()] == ["a:f"]
    assert {r.call_id: (r.to_symbol_id, r.rule) for r in resolved.collect()} == {"1": ("b:C.m", 4), "2": (None, None), "3": ("b:C", 2)}
