"""Text labels computed as CASE expressions on result rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strength(abs_r: Column) -> Column:
    # Thresholds and names of the correlation-strength scale.
    return (
        F.when(abs_r >= 0.8, "Very Strong")
        .when(abs_r >= 0.6, "Strong")
        .when(abs_r >= 0.4, "Moderate")
        .when(abs_r >= 0.2, "Weak")
        .otherwise("Very Weak")
    )


def direction(r: Column) -> Column:
    """Positive only when r > 0; zero counts as negative."""
    return F.when(r > 0, "positive").otherwise("negative")


def skew_label(s: Column) -> Column:
    # Skewness descriptions.
    return (
        F.when(F.abs(s) < 0.5, "approximately symmetric")
        .when(s > 0, "right-skewed (positive skew)")
        .when(s.isNotNull(), "left-skewed (negative skew)")
    )


def kurt_label(k: Column) -> Column:
    # Kurtosis descriptions.
    return (
        F.when(F.abs(k) < 0.5, "normal tail behavior (mesokurtic)")
        .when(k > 0, "heavy tails (leptokurtic)")
        .when(k.isNotNull(), "light tails (platykurtic)")
    )


def distribution_type(skew: Column, kurt: Column, minimum: Column) -> Column:
    """Branch order matters: normal, then |skew| > 1, then non-negative and |skew| > .5."""
    a = F.abs(skew)
    # Distribution-type suggestions.
    return (
        F.when((a < 0.5) & (F.abs(kurt) < 0.5), "Normal distribution")
        .when(a > 1, "Exponential or Log-normal distribution")
        .when((minimum >= 0) & (a > 0.5), "Gamma or Weibull distribution")
        .otherwise("Non-standard distribution")
    )


def significance_word(p: Column) -> Column:
    return F.when(p < 0.05, "Significant").otherwise("Non-significant")
