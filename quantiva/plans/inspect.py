"""Plan checks used by tests and by callers who want to assert a plan shape."""

from __future__ import annotations

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def assert_no_cartesian(df: DataFrame) -> None:
    plan = physical_plan(df)
    if "CartesianProduct" in plan:
        raise AssertionError("plan contains a CartesianProduct:\n" + plan)


def assert_no_global_window(df: DataFrame) -> None:
    """No window fed by a single-partition exchange (a window without
    ``partitionBy`` over its input runs in one task)."""
    lines = physical_plan(df).splitlines()
    for i, line in enumerate(lines):
        if "Window [" not in line or "WindowGroupLimit" in line:
            continue
        for below in lines[i + 1:]:
            if "Exchange" in below:
                if "SinglePartition" in below:
                    raise AssertionError("window over a single partition:\n" + line.strip())
                break
