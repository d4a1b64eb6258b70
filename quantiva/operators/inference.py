"""Hypothesis tests (H1-H8): Pearson test, one-way ANOVA, chi-square independence.

Statistics come from grouped aggregates (one row per group or cell); raw
rows are never shuffled beyond partial aggregation.  p-values come from the
pandas-UDF kernels, applied to the one-row results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError, ValidationError
from ..functions import labels
from ..functions.columns import as_double, check_columns, col
from ..functions.pvalues import chi2_sf, chi2_test_p, f_test_p, pearson_p
from .roles import numeric_columns

TEST_TYPES = ("auto", "correlation", "anova", "chi_square")
ALPHA = 0.05

# Test names and recommendation sentences.
PEARSON = "Pearson Correlation"
ANOVA = "One-way ANOVA"
CHI2 = "Chi-square Test of Independence"
REC_SIGNIFICANT = "The test result is statistically significant (p < 0.05)"
REC_BY_TEST = {
    PEARSON: "Consider investigating the relationship further with regression analysis",
    ANOVA: "Consider post-hoc tests to identify which groups differ significantly",
    CHI2: "Examine the contingency table to understand the nature of the association",
}
REC_NOT_SIGNIFICANT = [
    "The test result is not statistically significant (p >= 0.05)",
    "There is insufficient evidence to reject the null hypothesis",
]

MAX_CELLS = 10_000   # of the group list or contingency table in a result row
MAX_COLUMNS = 1_000  # of the wide contingency table
RESULT_COLUMNS = ["test_type", "variables", "statistic", "p_value", "df1", "df2", "n",
                  "is_significant", "interpretation", "recommendations"]


def _recommendations(test_type: str, p):
    return F.when(p < ALPHA, F.array(F.lit(REC_SIGNIFICANT), F.lit(REC_BY_TEST[test_type]))).otherwise(
        F.array(*[F.lit(t) for t in REC_NOT_SIGNIFICANT]))


def _one_row(df: DataFrame) -> DataFrame:
    """A one-row result as literals (its aggregate runs once)."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def pearson_test(df: DataFrame, column1: str, column2: str) -> DataFrame:
    """H3: r, two-sided p (t with n-2 dof), n on pairwise-complete rows (one row).

    Fewer than three complete pairs raise ``AnalysisError``."""
    check_columns(df, [column1, column2])
    a, b = as_double(df, column1), as_double(df, column2)
    both = a.isNotNull() & b.isNotNull()
    a2, b2 = F.when(both, a), F.when(both, b)
    denom = F.stddev_pop(a2) * F.stddev_pop(b2)
    row = df.agg(F.count_if(both).cast("long").alias("n"),
                 F.try_divide(F.covar_pop(a2, b2), F.when(denom > 0, denom)).alias("r"))
    row = _one_row(row)
    if row.first()["n"] < 3:
        raise AnalysisError("Insufficient data for correlation test")
    r = F.when(F.col("r").isNotNull(), F.greatest(F.least(F.col("r"), F.lit(1.0)), F.lit(-1.0)))
    p = pearson_p(r, F.col("n"))
    out = row.select(r.alias("r"), "n", p.alias("p_value"))
    return out.select(
        F.lit(PEARSON).alias("test_type"), F.array(F.lit(column1), F.lit(column2)).alias("variables"),
        F.col("r").alias("statistic"), "p_value",
        (F.col("n") - 2).cast("long").alias("df1"), F.lit(None).cast("long").alias("df2"), "n",
        (F.col("p_value") < ALPHA).alias("is_significant"),
        F.concat(labels.significance_word(F.col("p_value")), F.lit(" "),
                 F.lower(labels.strength(F.abs(F.col("r")))), F.lit(" correlation")).alias("interpretation"),
        _recommendations(PEARSON, F.col("p_value")).alias("recommendations"),
    )


def anova_groups(df: DataFrame, numeric: str, category: str) -> DataFrame:
    """H4 groups: group, n, mean, var (sample) of ``numeric`` per non-null category."""
    check_columns(df, [numeric, category])
    x = as_double(df, numeric)
    g = col(category)
    return (df.select(g.cast("string").alias("group"), x.alias("x"))
            .where(F.col("group").isNotNull() & F.col("x").isNotNull())
            .groupBy("group").agg(F.count(F.lit(1)).cast("long").alias("n"), F.avg("x").alias("mean"),
                                  F.var_samp("x").alias("var")))


def anova_test(df: DataFrame, numeric: str, category: str) -> DataFrame:
    """H4: one-way ANOVA F and p over groups with at least one value (one row).

    SSB = sum n_g (mean_g - grand)^2, SSW = sum (n_g - 1) var_g, from the
    per-group table; the grand mean is a scalar subquery over that table.
    Fewer than two groups raise ``AnalysisError``.
    """
    gs = anova_groups(df, numeric, category)
    grand = gs.select(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))).scalar()
    t = gs.agg(
        F.count(F.lit(1)).cast("long").alias("k"), F.sum("n").cast("long").alias("n"),
        F.sum(F.col("n") * (F.col("mean") - grand) * (F.col("mean") - grand)).alias("ssb"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0))).alias("ssw"),
    )
    t = _one_row(t)
    if t.first()["k"] < 2:
        raise AnalysisError("Need at least 2 groups for ANOVA")
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.try_divide(F.col("ssb") / d1, F.try_divide(F.col("ssw"), d2.cast("double")))
    out = t.select("k", "n", d1.cast("long").alias("df1"), d2.cast("long").alias("df2"), f.alias("statistic"))
    out = out.select("*", F.when(F.col("k") >= 2, f_test_p(F.col("statistic"), F.col("df1"), F.col("df2"))).alias("p_value"))
    return out.select(
        F.lit(ANOVA).alias("test_type"), F.array(F.lit(numeric), F.lit(category)).alias("variables"),
        "statistic", "p_value", "df1", "df2", "n",
        (F.col("p_value") < ALPHA).alias("is_significant"),
        F.concat(labels.significance_word(F.col("p_value")), F.lit(" difference between groups")).alias("interpretation"),
        _recommendations(ANOVA, F.col("p_value")).alias("recommendations"),
        F.col("k").alias("groups"),
    )


def crosstab(df: DataFrame, column1: str, column2: str) -> DataFrame:
    """H6 long form: a, b, n over rows where both are non-null (pandas crosstab drops NULLs)."""
    check_columns(df, [column1, column2])
    return (df.select(col(column1).cast("string").alias("a"), col(column2).cast("string").alias("b"))
            .where(F.col("a").isNotNull() & F.col("b").isNotNull())
            .groupBy("a", "b").agg(F.count(F.lit(1)).cast("long").alias("n")))


def crosstab_wide(df: DataFrame, column1: str, column2: str, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """H6 wide form: one row per value of column1, one column per value of column2.

    The values of column2 are counted first; more than ``max_columns`` raise ``AnalysisError`` (``crosstab``
    gives the table in long form at any size)."""
    ct = crosstab(df, column1, column2)
    values = [r["b"] for r in ct.select("b").distinct().orderBy("b").limit(int(max_columns) + 1).collect()]
    if len(values) > max_columns:
        raise AnalysisError(f"Column '{column2}' has more than {max_columns} values for a wide contingency table; use the long form")
    return ct.groupBy("a").pivot("b", values).agg(F.first("n")).na.fill(0)


def _listed(rows: DataFrame, cell, order: list[str], what: str) -> Column:
    """The rows of a small table as one literal array; more than MAX_CELLS raise ``AnalysisError``."""
    got = rows.orderBy(*order).limit(MAX_CELLS + 1).collect()
    if len(got) > MAX_CELLS:
        raise AnalysisError(f"More than {MAX_CELLS} {what} for a result row; use the long form")
    return F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in cell]) for r in got])


def chi_square_test(df: DataFrame, column1: str, column2: str) -> DataFrame:
    """H5: chi-square test of independence (one row).

    chi2 = sum (O - E)^2 / E over the non-empty cells plus, for the empty
    ones, N - sum E over the non-empty cells: the r x c grid is never
    materialised, and a weak association loses no digits.  All products are
    in double, so counts of any size fit.  With one degree of freedom (2 x 2)
    the continuity correction is applied cell by cell (|O - E| reduced by at
    most 0.5), which needs all four cells: that table is bounded (4 cells)
    and is finished on the driver.  One row or column: chi2 = 0, p = 1.
    """
    return chi_square_of(crosstab(df, column1, column2), column1, column2)


def chi_square_of(ct: DataFrame, column1: str, column2: str) -> DataFrame:
    """The test on a contingency table in long form (a, b, n)."""
    dims = ct.agg(F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"),
                  F.coalesce(F.sum(F.col("n").cast("decimal(38,0)")), F.lit(0)).alias("N")).collect()[0]
    r, c, n = int(dims["r"]), int(dims["c"]), int(dims["N"])
    if n == 0:
        raise AnalysisError("No valid data for chi-square test")
    dof = (r - 1) * (c - 1)
    spark = ct.sparkSession
    if dof == 1:
        cells = {(x["a"], x["b"]): x["n"] for x in ct.collect()}  # exactly a 2 x 2 table
        rows = sorted({k[0] for k in cells})
        cols = sorted({k[1] for k in cells})
        rs = {i: sum(cells.get((i, j), 0) for j in cols) for i in rows}
        cs = {j: sum(cells.get((i, j), 0) for i in rows) for j in cols}
        chi2 = 0.0
        for i in rows:
            for j in cols:
                e = rs[i] * cs[j] / n
                o = cells.get((i, j), 0)
                d = abs(o - e) - min(0.5, abs(o - e))
                chi2 += d * d / e
        base = spark.createDataFrame([(chi2, 1, n, chi2_sf(chi2, 1))], "statistic double, df1 long, n long, p_value double")
    elif dof == 0:
        base = spark.createDataFrame([(0.0, 0, n, 1.0)], "statistic double, df1 long, n long, p_value double")
    else:
        rs = ct.groupBy("a").agg(F.sum(F.col("n").cast("double")).alias("R"))
        cs = ct.groupBy("b").agg(F.sum(F.col("n").cast("double")).alias("C"))
        e = F.col("R") * F.col("C") / F.lit(float(n))
        o = F.col("n").cast("double")
        s = ct.join(rs, "a").join(cs, "b").agg(F.sum((o - e) * (o - e) / e).alias("s"), F.sum(e).alias("e"))
        empty = F.when(F.lit(r * c) > ct.agg(F.count(F.lit(1))).scalar(), F.lit(float(n)) - F.col("e")).otherwise(0.0)
        base = s.select((F.col("s") + empty).alias("statistic"), F.lit(dof).cast("long").alias("df1"), F.lit(n).cast("long").alias("n"))
        base = base.select("*", chi2_test_p(F.col("statistic"), F.col("df1")).alias("p_value"))
    return base.select(
        F.lit(CHI2).alias("test_type"), F.array(F.lit(column1), F.lit(column2)).alias("variables"),
        "statistic", "p_value", "df1", F.lit(None).cast("long").alias("df2"), "n",
        (F.col("p_value") < ALPHA).alias("is_significant"),
        F.concat(labels.significance_word(F.col("p_value")), F.lit(" association between variables")).alias("interpretation"),
        _recommendations(CHI2, F.col("p_value")).alias("recommendations"),
    )


def hypothesis_test(df: DataFrame, column1: str, column2: str, test_type: str = "auto", details: bool = False) -> DataFrame:
    """H1/H2: auto picks by strict-numeric roles (num x num -> Pearson, num x cat -> ANOVA
    with the numeric column first, cat x cat -> chi-square); explicit types are honoured.

    ``details`` adds three columns, null where they do not apply: ``groups`` (number of groups of an
    ANOVA), ``group_sizes`` (array of group and n, by group) and ``contingency`` (array of a, b and n of the
    non-empty cells, by a and b).  More than ``MAX_CELLS`` groups or cells raise ``AnalysisError`` then."""
    if test_type not in TEST_TYPES:
        raise ValidationError(f"Unsupported test type: {test_type}")
    check_columns(df, [column1, column2])
    if test_type == "auto":
        num = set(numeric_columns(df.select(col(column1), col(column2))))
        n1, n2 = column1 in num, column2 in num
        if n1 and n2:
            test_type = "correlation"
        elif n1 or n2:
            test_type = "anova"
            if n2:
                column1, column2 = column2, column1
        else:
            test_type = "chi_square"
    groups, sizes, table = F.lit(None), F.lit(None), F.lit(None)
    if test_type == "correlation":
        out = pearson_test(df, column1, column2)
    elif test_type == "anova":
        out = anova_test(df, column1, column2)
        if details:
            groups = F.col("groups")
            sizes = _listed(anova_groups(df, column1, column2), ["group", "n"], ["group"], "groups")
    else:
        out = chi_square_test(df, column1, column2)
        if details:
            table = _listed(crosstab(df, column1, column2), ["a", "b", "n"], ["a", "b"], "cells")
    if not details:
        return out.select(*RESULT_COLUMNS)
    return out.select(*RESULT_COLUMNS, groups.cast("long").alias("groups"),
                      sizes.cast("array<struct<group:string,n:bigint>>").alias("group_sizes"),
                      table.cast("array<struct<a:string,b:string,n:bigint>>").alias("contingency"))
