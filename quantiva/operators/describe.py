"""Descriptive statistics (D1-D14): one row per numeric column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.columns import as_double, check_columns, name_at
from . import ranks
from .roles import numeric_columns


_MOMENTS = ["count", "mean", "std_dev", "variance", "min", "max", "skewness", "kurtosis", "std_pop"]


def _moment_aggs(values) -> list:
    aggs = []
    for i, x in enumerate(values):
        aggs += [
            F.count(x).alias(f"count{i}"), F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std_dev{i}"), F.var_samp(x).alias(f"variance{i}"),
            F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
            F.skewness(x).alias(f"skewness{i}"), F.kurtosis(x).alias(f"kurtosis{i}"),
            F.stddev_pop(x).alias(f"std_pop{i}"),
        ]
    return aggs


def _long_moments(wide: DataFrame, n: int) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("cid"), *[F.col(f"{m}{i}").alias(m) for m in _MOMENTS]) for i in range(n)]
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    # NaN (zero variance in skewness/kurtosis) is reported as NULL.
    return out.select(*[F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c not in ("cid", "count") else F.col(c)
                        for c in out.columns])


def _moments(df: DataFrame, names: list[str]) -> DataFrame:
    """One wide aggregate (partial + final, fixed-size buffers), returned long: one row per column."""
    return _long_moments(df.agg(*_moment_aggs([as_double(df, n) for n in names])), len(names))


def moments_and_sketch(df: DataFrame, names: list[str], probs: dict[str, float], heavy: bool = False):
    """(moments, sketch, heavy): one scan gives every column's moments (a literal table of one row per
    column), the bracketing sketch that ``ranks.exact_quantiles`` starts from and, if asked for, what
    ``ranks.modes`` starts from."""
    values = [as_double(df, n) for n in names]
    row = df.agg(*_moment_aggs(values), *ranks.sketch_aggs(values, probs), *(ranks.heavy_aggs(values) if heavy else [])).collect()[0]
    spark = df.sparkSession

    def clean(v):  # NaN (zero variance in skewness/kurtosis) is reported as NULL
        return None if isinstance(v, float) and math.isnan(v) else v

    mom = spark.createDataFrame(
        [tuple([i] + [clean(row[f"{m}{i}"]) for m in _MOMENTS]) for i in range(len(names))],
        "cid int, count long, " + ", ".join(f"{m} double" for m in _MOMENTS[1:]))
    parts = [(f"_n{i}", f"_u{i}", f"_s{i}") for i in range(len(names))]
    schema = ", ".join(f"{n} long, {u} long, {s} array<double>" for n, u, s in parts)
    sketch = spark.createDataFrame([tuple(row[c] for three in parts for c in three)], schema)
    return mom, sketch, [(row[f"_n{i}"], row[f"_t{i}"]) for i in range(len(names))] if heavy else None


def resolve_numeric(df: DataFrame, columns) -> list[str]:
    if columns is None:
        return numeric_columns(df)
    if isinstance(columns, str):
        columns = [columns]
    names = check_columns(df, columns)
    numeric = set(numeric_columns(df.select(*[F.col(f"`{n}`") for n in names])))
    bad = [n for n in names if n not in numeric]
    if bad:
        raise ValidationError(f"Column '{bad[0]}' is not numeric")
    return names


def _approx_quartiles(df: DataFrame, names: list[str], accuracy: int) -> DataFrame:
    """(cid, q1, median, q3) from one pass of percentile_approx sketches (opt-in:
    rank error <= n / accuracy, no interpolation, no value-count shuffle)."""
    row = df.agg(*[F.percentile_approx(as_double(df, n), [0.25, 0.5, 0.75], accuracy).alias(f"p{i}")
                   for i, n in enumerate(names)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("cid"), F.col(f"p{i}")[0].cast("double").alias("q1"),
                 F.col(f"p{i}")[1].cast("double").alias("median"), F.col(f"p{i}")[2].cast("double").alias("q3"))
        for i in range(len(names))])).alias("r")).select("r.*")


def descriptive(df: DataFrame, columns=None, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """count, mean, median, mode, std_dev, variance, min, max, range, q1, q3, iqr,
    skewness, kurtosis (population, excess), coef_var (std/mean*100, NULL at mean 0).

    ``approx=True`` takes quartiles and median from ``percentile_approx``
    instead of the exact order statistics (the mode stays exact)."""
    names = resolve_numeric(df, columns)
    if not names:
        raise ValidationError("No numeric columns to describe")
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    mom, sketch, heavy = moments_and_sketch(df, names, probs, heavy=True)
    values = [as_double(df, n) for n in names]
    if approx:
        qs = _approx_quartiles(df, names, accuracy)
    else:
        qs = ranks.exact_quantiles(df, values, probs, sketch=sketch)
    mode = ranks.modes(df, values, [t for _, t in heavy], [n for n, _ in heavy])
    res = mom.join(qs.drop("n"), "cid", "left").join(mode, "cid", "left")
    return res.select(
        name_at(names, F.col("cid")).alias("column"),
        F.col("count").cast("long").alias("count"),
        "mean", "median", "mode", "std_dev", "variance", "min", "max",
        (F.col("max") - F.col("min")).alias("range"),
        "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
        "skewness", "kurtosis",
        F.when(F.col("mean") != 0, F.col("std_dev") / F.col("mean") * 100).alias("coef_var"),
        # Fixed value: the one-line summary format.
        F.format_string("Descriptive statistics for '%s': Mean = %.2f, Std Dev = %.2f, Range = [%.2f, %.2f]",
                        name_at(names, F.col("cid")), F.bround("mean", 2), F.bround("std_dev", 2), F.bround("min", 2),
                        F.bround("max", 2)).alias("summary"),
    ).orderBy("column")
