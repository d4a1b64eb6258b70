"""Plan shape of every registered query."""

import __spark_entry__ as E
from quantiva.plans.inspect import assert_no_global_window

SF = "/root/testdata/sf0.001"


def test_no_cartesian_nested_loop_or_global_window_in_any_registered_query(spark):
    bad = []
    for key, fn in E.queries().items():
        df = fn(spark, SF)
        df.collect()  # final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        hits = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
        try:
            assert_no_global_window(df)
        except AssertionError:
            hits.append("single-partition window")
        if hits:
            bad.append((key, hits))
    assert bad == []


def test_scan_pruning_and_pushdown(spark):
    fn = E.queries()["filter_rows"]
    plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_discount), GreaterThan(l_quantity,45.0)" in plan
    scan = [l for l in plan.splitlines() if "FileScan parquet" in l][0]
    assert "l_shipdate" not in scan and "l_returnflag" not in scan  # only the needed columns are read
    top = E.queries()["top_k"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
