"""Distribution shape (N1-N4, N6), histogram (Q8) and per-group distribution (Q9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import labels
from ..functions.columns import as_double, check_columns, col, name_at
from . import ranks
from .describe import _moments, resolve_numeric


def distribution(df: DataFrame, columns=None) -> DataFrame:
    """column, n, skewness, kurtosis, min, skew_label, kurt_label, distribution_type."""
    names = resolve_numeric(df, columns)
    m = _moments(df, names)
    return m.select(
        name_at(names, F.col("cid")).alias("column"),
        F.col("count").cast("long").alias("n"), "skewness", "kurtosis", "min",
        labels.skew_label(F.col("skewness")).alias("skew_label"),
        labels.kurt_label(F.col("kurtosis")).alias("kurt_label"),
        labels.distribution_type(F.col("skewness"), F.col("kurtosis"), F.col("min")).alias("distribution_type"),
    )


def distribution_report(df: DataFrame, columns=None, max_n: int = 5000, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """N1-N6 in one row per column: shape, labels, suggested type, Shapiro-Wilk
    on the seeded sample, and the interpretation sentence (p with 4 decimals)."""
    from .normality import normality

    shape = distribution(df, columns)
    norm = normality(df, columns, max_n=max_n, seed=seed, key=key).select("column", "statistic", "p_value", "is_normal",
                                                                  "sample_size_used")
    j = shape.join(norm, "column", "left")
    # Fixed value: the sentence.
    text = F.format_string(
        "Distribution analysis for '%s': %s distribution (Shapiro-Wilk p-value: %.4f). Shape: %s, %s. Suggested type: %s",
        F.col("column"), F.when(F.col("is_normal"), "Normal").otherwise("Non-normal"), F.bround("p_value", 4),
        F.col("skew_label"), F.col("kurt_label"), F.col("distribution_type"))
    return j.select("column", "n", "skewness", "kurtosis", "skew_label", "kurt_label", "distribution_type",
                    "statistic", "p_value", "is_normal", "sample_size_used", text.alias("interpretation"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed (numpy ``histogram``):
    bin, lo, hi, count; empty bins are listed with count 0."""
    check_columns(df, [column])
    bins = int(bins)
    if bins < 1:
        raise ValidationError("bins must be >= 1")
    x = df.select(as_double(df, column).alias("x")).where(F.col("x").isNotNull())
    # one-row stats, inlined as literals (numpy widens a zero range by 0.5 each side)
    mn, mx = x.agg(F.min("x"), F.max("x")).collect()[0]
    spark = df.sparkSession
    if mn is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count long")
    if mn == mx:
        mn, mx = mn - 0.5, mx + 0.5
    width = (mx - mn) / bins
    # numpy's rule: scaled index, the maximum in the last bin, then one step of
    # correction against the edges start + k * step where rounding put a value
    # on the wrong side of an edge
    xv = F.col("x")
    i1 = F.least(F.floor((xv - F.lit(mn)) * F.lit(bins / (mx - mn))), F.lit(bins - 1)).cast("int")
    lo_edge = F.lit(mn) + i1 * F.lit(width)
    hi_edge = F.lit(mn) + (i1 + 1) * F.lit(width)
    idx = (F.when(xv < lo_edge, i1 - 1)
           .when((xv >= hi_edge) & (i1 != bins - 1), i1 + 1)
           .otherwise(i1))
    counts = x.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


def distribution_by_group(df: DataFrame, by: str, column: str) -> DataFrame:
    """by, n, min, q1, median, q3, max, mean of ``column`` per non-null group.

    Exact quartiles by selection (``ranks.exact_quantiles``), so a hot group costs no more than
    its rows: only sketches, counts and the rows around the quartiles are shuffled.
    """
    check_columns(df, [by, column])
    base = df.select(col(by).alias("_g"), as_double(df, column).alias("_x")).where(
        F.col("_g").isNotNull() & F.col("_x").isNotNull())
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    x = F.col("_x")
    facts = ranks.stored_table(base.groupBy("_g").agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
                                                      *ranks.sketch_aggs([x], probs)), "group-facts")
    q = ranks.exact_quantiles(base, [x], probs, keys={"_g": F.col("_g")}, sketch=facts.drop("min", "max", "mean"))
    return q.drop("cid").join(facts.select("_g", "min", "max", "mean"), "_g").select(
        F.col("_g").alias(by), F.col("n").cast("long").alias("n"), "min", "q1", "median", "q3", "max", "mean")
