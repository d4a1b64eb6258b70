"""Outliers (O1-O5): IQR fences and |z| > 3, per numeric column.

Exact quartiles (ranks.exact_quantiles) and population moments give one row
of statistics per column; these become literals, so raw rows are flagged
where they are read.  Only flag counts and the first k values of each task
are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.columns import as_double, check_columns, col, name_at
from . import ranks
from .describe import moments_and_sketch, resolve_numeric

Z_THRESHOLD = 3.0
IQR_FACTOR = 1.5
METHODS = ("iqr", "zscore")


def column_stats(df: DataFrame, names: list[str]) -> list[dict]:
    """n, q1, q3, lower_bound, upper_bound, mean, std_pop of each column (None without values)."""
    probs = {"q1": 0.25, "q3": 0.75}
    mom, sketch, _ = moments_and_sketch(df, names, probs)
    q = {r["cid"]: r for r in ranks.exact_quantiles(df, [as_double(df, n) for n in names], probs, sketch=sketch).collect()}
    out = []
    for r in mom.orderBy("cid").collect():  # one row per column
        own = q.get(r["cid"])
        if own is None:
            out.append({"n": 0, "q1": None, "q3": None, "lower_bound": None, "upper_bound": None, "mean": None, "std_pop": None})
            continue
        iqr = own["q3"] - own["q1"]
        out.append({"n": r["count"], "q1": own["q1"], "q3": own["q3"], "lower_bound": own["q1"] - IQR_FACTOR * iqr,
                    "upper_bound": own["q3"] + IQR_FACTOR * iqr, "mean": r["mean"], "std_pop": r["std_pop"]})
    return out


def _flag(v, st: dict, method: str):
    """(is an outlier, distance) of a value, with the column's statistics as literals."""
    if method == "iqr":
        lo, hi = (F.lit(st[x]).cast("double") for x in ("lower_bound", "upper_bound"))
        return F.coalesce((v < lo) | (v > hi), F.lit(False)), F.greatest(lo - v, v - hi)
    if not st["std_pop"]:
        return F.lit(False), F.lit(None).cast("double")
    z = F.abs((v - F.lit(st["mean"])) / F.lit(st["std_pop"]))
    return F.coalesce(z > F.lit(Z_THRESHOLD), F.lit(False)), z


def _check_methods(methods) -> list[str]:
    methods = [methods] if isinstance(methods, str) else list(methods or METHODS)
    bad = [m for m in methods if m not in METHODS]
    if bad:
        raise ValidationError(f"Unknown outlier method(s): {', '.join(bad)}")
    return methods


def _cells(df: DataFrame, names: list[str], stats: list[dict], methods: list[str]):
    """(column number, method, value, flag, distance) of every column and method."""
    for i, n in enumerate(names):
        v = as_double(df, n)
        for m in methods:
            yield i, m, v, *_flag(v, stats[i], m)


def _first_values(df: DataFrame, names: list[str], stats: list[dict], methods: list[str], k: int) -> DataFrame:
    """column, method, rank, value: the first k flagged values, farthest first, then value asc."""
    structs = [F.struct(F.lit(i).alias("cid"), F.lit(m).alias("method"), v.alias("value"), d.alias("_d"), flag.alias("_f"))
               for i, m, v, flag, d in _cells(df, names, stats, methods)]
    hit = df.select(F.explode(F.filter(F.array(*structs), lambda s: s["_f"])).alias("p")).select("p.*")
    w = Window.partitionBy("cid", "method").orderBy(F.col("_d").desc(), F.col("value").asc())
    # row_number() <= k is planned as a window-group limit: k rows per task and group before the shuffle
    top = hit.select("cid", "method", "value", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    return top.select(name_at(names, F.col("cid")).alias("column"), "method", F.col("rank").cast("long").alias("rank"), "value")


def outlier_values(df: DataFrame, columns=None, methods=METHODS, k: int = 10) -> DataFrame:
    """O3 in long form: column, method, rank, value -- the first k outlier values
    (repeats kept), farthest from the fence (largest |z|) first, then value asc."""
    names = resolve_numeric(df, columns)
    return _first_values(df, names, column_stats(df, names), _check_methods(methods), k)


def _counts(df: DataFrame, names: list[str], stats: list[dict], methods: list[str]) -> DataFrame:
    """column, method, count, percentage (of non-null), lower_bound, upper_bound, threshold."""
    cells = list(_cells(df, names, stats, methods))
    wide = df.agg(*[F.count_if(flag).alias(f"c{x}") for x, (_, _, _, flag, _) in enumerate(cells)])
    rows = []
    for x, (i, m, *_) in enumerate(cells):
        st = stats[i]
        rows.append(F.struct(
            F.lit(names[i]).alias("column"), F.lit(m).alias("method"), F.col(f"c{x}").cast("long").alias("count"),
            F.lit(st["n"]).cast("long").alias("n"),
            F.lit(st["lower_bound"] if m == "iqr" else None).cast("double").alias("lower_bound"),
            F.lit(st["upper_bound"] if m == "iqr" else None).cast("double").alias("upper_bound"),
            F.lit(Z_THRESHOLD if m == "zscore" else None).cast("double").alias("threshold")))
    long = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("n") > 0)
    return long.select("column", "method", "count", (F.try_divide(F.col("count"), F.col("n")) * 100).alias("percentage"),
                       "lower_bound", "upper_bound", "threshold")


def outliers(df: DataFrame, columns=None, methods=METHODS, k: int = 10) -> DataFrame:
    """Column, method, count, percentage (of non-null), lower_bound,
    upper_bound (IQR), threshold (z), outlier_values (first k, see outlier_values)."""
    names = resolve_numeric(df, columns)
    methods = _check_methods(methods)
    stats = column_stats(df, names)
    vals = _first_values(df, names, stats, methods, k).groupBy("column", "method").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("outlier_values"))
    return _counts(df, names, stats, methods).join(vals, ["column", "method"], "left").select(
        "column", "method", "count", "percentage", "lower_bound", "upper_bound", "threshold",
        F.coalesce(F.col("outlier_values"), F.array().cast("array<double>")).alias("outlier_values"))


def outlier_rows(df: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    """The input rows whose ``column`` is an outlier, with a score column
    (distance beyond the fence for IQR, |z| for z-score)."""
    check_columns(df, [column])
    (method,) = _check_methods([method])
    (st,) = column_stats(df, [column])
    x = as_double(df, column)
    flag, score = _flag(x, st, method)
    return df.select(*[col(c) for c in df.columns], flag.alias("__flag"), score.alias("score")).where("__flag").drop("__flag")


def outlier_summary(df: DataFrame, columns=None, methods=METHODS) -> DataFrame:
    """Total outliers over columns and methods, and one line per (column, method)."""
    names = resolve_numeric(df, columns)
    o = _counts(df, names, column_stats(df, names), _check_methods(methods)).select("column", "method", "count", "percentage")
    total = o.select(F.sum("count")).scalar()  # scalar subquery; its exchanges are reused
    return o.select(
        "column", "method", "count",
        total.cast("long").alias("total_outliers"),
        # Fixed value: the per-method summary format.
        F.format_string("%s: %d outliers (%.1f%%)", F.upper("method"), "count", F.bround("percentage", 1)).alias("summary"),
    )
