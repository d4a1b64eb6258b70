"""Everyday questions (Q2-Q5, Q12-Q13): group, compare, filter, top-k, preview, SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.columns import as_double, check_columns, col

# Aggregate names accepted by group_aggregate.
AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max,
    "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct,
}


def group_aggregate(df: DataFrame, by, measures: dict[str, list[str] | str]) -> DataFrame:
    """Q2: groupBy(by) with {column: [agg, ...]}; outputs ``<agg>_<column>``."""
    by = [by] if isinstance(by, str) else list(by)
    check_columns(df, by + list(measures))
    aggs = []
    for c, fns in measures.items():
        for fn in ([fns] if isinstance(fns, str) else fns):
            if fn not in AGGREGATES:
                raise ValidationError(f"Unknown aggregate: {fn}")
            x = col(c) if fn in ("count", "nunique", "min", "max") else as_double(df, c)
            aggs.append(AGGREGATES[fn](x).alias(f"{fn}_{c}"))
    return df.groupBy(*[col(b) for b in by]).agg(*aggs)


def compare_groups(df: DataFrame, by: str, measure: str) -> DataFrame:
    """Q3: by, n, mean, diff_from_overall (group mean minus the overall mean of all rows)."""
    check_columns(df, [by, measure])
    x = as_double(df, measure)
    base = df.select(col(by).alias(by), x.alias("_x")).where(F.col("_x").isNotNull())
    overall = base.select(F.avg("_x")).scalar()  # scalar subquery, evaluated once
    g = base.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).cast("long").alias("n"),
                                                         F.avg("_x").alias("mean"))
    return g.select(by, "n", "mean", (F.col("mean") - overall).alias("diff_from_overall"))


def filter_rows(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Rows matching a SQL predicate or Column (pushed down to the scan)."""
    return df.where(F.expr(predicate) if isinstance(predicate, str) else predicate)


def top_k(df: DataFrame, by: str, k: int = 5, tie_breaker: list[str] | None = None, ascending: bool = False) -> DataFrame:
    """Q5: k rows with the largest (or smallest) ``by``; ties broken by ``tie_breaker``.

    orderBy + limit is planned as TakeOrderedAndProject: each task keeps k rows.
    """
    check_columns(df, [by] + list(tie_breaker or []))
    if int(k) < 1:
        raise ValidationError("k must be >= 1")
    key = col(by).asc_nulls_last() if ascending else col(by).desc_nulls_last()
    return df.orderBy(key, *[col(t).asc() for t in (tie_breaker or [])]).limit(int(k))


def preview(df: DataFrame, order_by: list[str] | str, n: int = 20) -> DataFrame:
    """Q12: first n rows in a stated order."""
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    check_columns(df, order_by)
    return df.orderBy(*[col(c) for c in order_by]).limit(int(n))


def adhoc_sql(df: DataFrame, query: str, view: str = "data") -> DataFrame:
    """Q13: free-form SQL over the table registered as a temporary view."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(query)
