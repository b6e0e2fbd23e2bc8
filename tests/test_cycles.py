from lodestrata.operators import graph as H
from lodestrata.sources.shared import store


def test_cycles_send_no_table_through_the_driver(spark, monkeypatch):
    """No join of the loops is a broadcast, since it would be sent anew each round, whatever its size."""
    plans = []

    def planned(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(H, "store", planned)
    edges = store(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 5)], "a long, b long"), "edges")
    got = H.import_cycles(edges)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert {r.node: r.component for r in got.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert not [p for p in plans if "Broadcast" in p] and any("SortMergeJoin" in p for p in plans)
