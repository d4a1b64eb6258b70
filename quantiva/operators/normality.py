"""Shapiro-Wilk normality (N5): seeded sample of at most ``max_n`` values per
column (and group), then one bounded ``applyInPandas`` task per column.

Sampling: the ``max_n`` smallest md5 digests of the seed and the row's key
columns, a pure function of the key, so reruns and recomputed tasks pick the
same rows and equal values are picked independently of each other.  Without
key columns the file and row number of Parquet rows are the key; for rows from
elsewhere a seeded random number stands for the digest.  A threshold on the
digest first keeps about 2 * max_n rows per column (a narrow filter), so the
ranking runs on a small remainder only.
W and p follow Royston's AS R94 (1995); numpy + ``statistics.NormalDist``
replace scipy.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double, check_columns, col, name_at
from .describe import resolve_numeric
from .ranks import stored_table

ALPHA = 0.05

# AS R94 polynomial coefficients (ascending powers).
C1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
C3 = [0.544, -0.39978, 0.025054, -6.714e-4]
C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
C6 = [-0.4803, -0.082676, 0.0030302]
G = [-2.273, 0.459]

_ND = NormalDist()


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_wilk(values) -> tuple[float | None, float | None]:
    """(W, p) for 3 <= n <= 5000 values; (None, None) when undefined (n < 3 or constant)."""
    x = np.sort(np.asarray(values, dtype="float64"))
    n = len(x)
    if n < 3 or x[-1] - x[0] <= 0:
        return None, None
    nn2 = n // 2
    a = np.zeros(nn2)
    if n == 3:
        a[0] = math.sqrt(0.5)
    else:
        m = np.array([_ND.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, nn2 + 1)])
        summ2 = 2.0 * float(np.sum(m * m))
        ssumm2 = math.sqrt(summ2)
        rsn = 1.0 / math.sqrt(n)
        a1 = _poly(C1, rsn) - m[0] / ssumm2
        if n > 5:
            a2 = -m[1] / ssumm2 + _poly(C2, rsn)
            fac = math.sqrt((summ2 - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))
            a[1] = a2
            start = 2
        else:
            fac = math.sqrt((summ2 - 2 * m[0] ** 2) / (1 - 2 * a1 ** 2))
            start = 1
        a[0] = a1
        a[start:] = -m[start:] / fac
    b = float(np.sum(a * (x[::-1][:nn2] - x[:nn2])))
    ssq = float(np.sum((x - x.mean()) ** 2))
    w = min(1.0, b * b / ssq)
    if n == 3:
        p = max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return w, p
    w1 = math.log(1.0 - w) if w < 1.0 else -math.inf
    if n <= 11:
        gamma = _poly(G, n)
        if w1 >= gamma:
            return w, 0.0
        y = -math.log(gamma - w1)
        mu = _poly(C3, n)
        sd = math.exp(_poly(C4, n))
    else:
        ln = math.log(n)
        y = w1
        mu = _poly(C5, ln)
        sd = math.exp(_poly(C6, ln))
    if math.isinf(y):
        return w, 1.0
    return w, _ND.cdf(-(y - mu) / sd)  # upper tail by symmetry: no cancellation


def _kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    w, p = shapiro_wilk(pdf["value"].to_numpy())
    return pd.DataFrame({"cid": [int(pdf["cid"].iloc[0])], "_g": [pdf["_g"].iloc[0]],
                         "statistic": [w], "p_value": [p], "sample_size_used": [len(pdf)],
                         "repeated": [len(pdf) - pdf["_h"].nunique()]})


_SPACE = 16 ** 15  # of the first 15 hex digits of a digest


def row_place(df: DataFrame) -> list | None:
    """File path and row number in it, where the rows come from Parquet files; else None."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        df.select(*[c.alias(f"_p{i}") for i, c in enumerate(place)])
    except AnalysisException:
        return None
    return place


def _digest(df: DataFrame, key: list[str] | None, seed: int):
    parts = [col(c) for c in key] if key is not None else row_place(df)
    if parts is None:
        return (F.rand(seed) * float(_SPACE)).cast("long")
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def normality(df: DataFrame, columns=None, by: str | None = None, max_n: int = 5000, seed: int = 42,
              key: list[str] | None = None) -> DataFrame:
    """column, (by), statistic (W), p_value, is_normal (p > .05), sample_size_used, n.

    Every column (and group) with values has a row; W and p are NULL where they are undefined
    (fewer than three values, or all equal).  ``key`` names columns that identify a row; if a column
    with more than ``max_n`` values meets a key that does not, the query fails with an error.  Without
    ``key`` rows of Parquet files are known by file and row number, so the sample stays the same however
    the rows are dealt to tasks; rows from elsewhere get a seeded random number.
    """
    names = resolve_numeric(df, columns)
    if key is not None:
        check_columns(df, key)
    g = col(by).cast("string") if by else F.lit("")  # a non-NULL constant group keeps the joins equi-joins
    wide = df.select(_digest(df, key, seed).alias("_h"), g.alias("_g"), *[as_double(df, n).alias(f"_v{i}") for i, n in enumerate(names)])
    long = wide.select("_h", "_g", F.explode(F.array(*[
        F.struct(F.lit(i).alias("cid"), F.col(f"_v{i}").alias("value")) for i in range(len(names))])).alias("p")).select(
        "_h", "_g", "p.cid", "p.value").where(F.col("value").isNotNull())
    if by:
        long = long.where(F.col("_g").isNotNull())
        counts = stored_table(long.groupBy("cid", "_g").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
        sized = long.join(counts, ["cid", "_g"])  # one row per column and group: broadcast if small
    else:
        row = df.agg(*[F.count(as_double(df, n)).alias(f"n{i}") for i, n in enumerate(names)]).collect()[0]
        sizes = [int(row[f"n{i}"]) for i in range(len(names))]
        counts = df.sparkSession.createDataFrame([(i, "", n) for i, n in enumerate(sizes) if n], "cid int, _g string, n long")
        sized = long.withColumn("n", F.get(F.array(*[F.lit(n).cast("long") for n in sizes]), F.col("cid")))
    few = F.col("n") <= 2 * max_n
    kept = sized.where(few | (F.col("_h") < F.lit(float(_SPACE)) * 2 * max_n / F.col("n")))
    w = Window.partitionBy("cid", "_g").orderBy("_h", "value")
    sample = kept.select("cid", "_g", "value", "_h", F.row_number().over(w).alias("_r")).where(F.col("_r") <= max_n)
    res = sample.select("cid", "_g", "value", "_h").groupBy("cid", "_g").applyInPandas(
        _kernel, "cid int, _g string, statistic double, p_value double, sample_size_used long, repeated long")
    joined = counts.join(res, ["cid", "_g"], "left")
    bad = (F.col("n") > max_n) & ((F.coalesce("sample_size_used", F.lit(0)) < max_n) | (F.col("repeated") > 0))
    used = F.when(bad, F.raise_error(F.lit("The sampling key does not identify rows"))).otherwise(F.col("sample_size_used"))
    return joined.select(
        name_at(names, F.col("cid")).alias("column"),
        *([F.col("_g").alias(by)] if by else []),
        "statistic", "p_value", (F.col("p_value") > ALPHA).alias("is_normal"), used.cast("long").alias("sample_size_used"),
        F.col("n").cast("long").alias("n"))
