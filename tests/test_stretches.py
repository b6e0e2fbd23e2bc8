"""Lines meet spans by stretch: the plans hold no join on a file alone, and borders of stretches lose nothing."""

from lodestrata.operators import graph as H


def _joins_on(df, key):
    """Whether each join of the plan that has the file among its keys has key among them too."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "path" in line]
    return bool(joins) and all(key in line for line in joins)


def _symbols(spark):
    rows = [(1, "s", "a", "function", "f", None, 1, 200), (2, "s", "a", "function", "g", None, 31, 33), (3, "s", "a", "function", "h", None, 64, 64), (4, "t", "a", "function", "i", None, 1, 5)]
    return spark.createDataFrame(rows, "symbol_id long, snapshot_id string, path string, kind string, name string, parent_id long, start_line int, end_line int")


def test_symbol_at(spark):
    points = spark.createDataFrame([(n, "s", "a", n) for n in (1, 31, 32, 33, 34, 63, 64, 65, 200, 201)], "point_id long, snapshot_id string, path string, line int")
    got = H.symbol_at(points, _symbols(spark))
    assert {r.line: r.symbol_id for r in got.collect()} == {1: 1, 31: 2, 32: 2, 33: 2, 34: 1, 63: 1, 64: 3, 65: 1, 200: 1, 201: None}
    assert _joins_on(got, "stretch")


def test_callees(spark):
    calls = spark.createDataFrame([("s", "a", n, f"c{n}", n) for n in (31, 32, 33, 34, 64)], "snapshot_id string, path string, line int, callee_text string, to_symbol_id long")
    got = H.callees(spark.createDataFrame([(1,), (2,), (3,)], "symbol_id long"), _symbols(spark), calls)
    assert {(r.symbol_id, r.line, r["rank"]) for r in got.collect()} == {(1, n, i + 1) for i, n in enumerate((31, 32, 33, 34, 64))} | {(2, 31, 1), (2, 32, 2), (2, 33, 3), (3, 64, 1)}
    assert _joins_on(got, "stretch")
