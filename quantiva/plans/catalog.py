"""Registered queries over the driver tables, and their DuckDB oracles.

Each query reads whole tables (or columns Spark derives from them).  Double
columns are compared at 8 significant digits on both sides through the same
text round trip (``%.7e``), which avoids the fixed-decimal rounding ties of
means such as 0.0499185.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import (adhoc, categorical, cleaning, conversations, correlate, describe, distribution, inference,
                         kendall, normality, outliers, profile, profile_state)
from ..session import read_table, scratch_dir
from ..sources import csv as csvsrc, storage

LINE4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE8 = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"] + LINE4


def _sig_col(c):
    """8 significant digits, half-even, by exact powers of ten (same arithmetic as ``S``)."""
    e = F.floor(F.log10(F.abs(c)))
    up = F.pow(F.lit(10.0), F.lit(7) - e)
    down = F.pow(F.lit(10.0), e - F.lit(7))
    return (F.when(c.isNull() | (c == 0) | F.isnan(c) | (F.abs(c) == float("inf")), c)
            .when(F.lit(7) - e >= 0, F.bround(c * up, 0) / up)
            .otherwise(F.bround(c / down, 0) * down))


def sig(df: DataFrame) -> DataFrame:
    """8 significant digits for every double column (same rule as ``S`` in SQL)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(_sig_col(c.cast("double")).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def S(e: str) -> str:
    return (f"list_transform([CAST(({e}) AS DOUBLE)], lambda v: CASE WHEN v IS NULL OR v = 0 OR isnan(v) OR isinf(v) THEN v "
            "WHEN 7 - floor(log10(abs(v))) >= 0 THEN round_even(v * power(10, 7 - floor(log10(abs(v)))), 0) "
            "/ power(10, 7 - floor(log10(abs(v)))) ELSE round_even(v / power(10, floor(log10(abs(v))) - 7), 0) "
            "* power(10, floor(log10(abs(v))) - 7) END)[1]")


def _t(spark, sf, name):
    return read_table(spark, sf, name)


# ---------------------------------------------------------------- descriptive
def q_descriptive(spark, sf):
    return sig(describe.descriptive(_t(spark, sf, "lineitem"), LINE4))


def sql_descriptive():
    parts = []
    for c in LINE4:
        parts.append(f"""
SELECT '{c}' AS "column", count({c}) AS count, {S(f'avg({c})')} AS mean, {S(f'quantile_cont({c}, 0.5)')} AS median,
  {S(f'(SELECT {c} FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)')} AS mode,
  {S(f'stddev_samp({c})')} AS std_dev, {S(f'var_samp({c})')} AS variance, {S(f'min({c})')} AS min, {S(f'max({c})')} AS max,
  {S(f'max({c}) - min({c})')} AS range, {S(f'quantile_cont({c}, 0.25)')} AS q1, {S(f'quantile_cont({c}, 0.75)')} AS q3,
  {S(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)')} AS iqr,
  {S(f'skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0))')} AS skewness,
  {S(f'kurtosis_pop({c})')} AS kurtosis,
  {S(f'CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}) / avg({c}) * 100 END')} AS coef_var,
  printf('Descriptive statistics for ''%s'': Mean = %.2f, Std Dev = %.2f, Range = [%.2f, %.2f]', '{c}',
         round_even(avg({c}), 2), round_even(stddev_samp({c}), 2), round_even(min({c}), 2), round_even(max({c}), 2)) AS summary
FROM lineitem""")
    return " UNION ALL ".join(parts)


def q_variable_summaries(spark, sf):
    return sig(profile.variable_summaries(_t(spark, sf, "lineitem"), limit=5))


def sql_variable_summaries():
    cols = LINE8[:5]
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {S(f'avg({c})')} AS mean, {S(f'stddev_samp({c})')} AS std, {S(f'min({c})')} AS min,
        {S(f'max({c})')} AS max, count(*) - count({c}) AS missing, count({c}) AS count FROM lineitem""" for c in cols)


# ---------------------------------------------------------------- correlation
def _strength_sql(r):
    a = f"abs({r})"
    return (f"CASE WHEN {r} IS NULL THEN NULL WHEN {a} >= 0.8 THEN 'Very Strong' WHEN {a} >= 0.6 THEN 'Strong' "
            f"WHEN {a} >= 0.4 THEN 'Moderate' WHEN {a} >= 0.2 THEN 'Weak' ELSE 'Very Weak' END")


def _dir_sql(r):
    return f"CASE WHEN {r} IS NULL THEN NULL WHEN {r} > 0 THEN 'positive' ELSE 'negative' END"


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def _pearson_sql(table, cols):
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS column1, '{b}' AS column2, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n,
        CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END AS correlation FROM {table}""" for a, b in _pairs(cols))


def _labelled(inner):
    return f"""SELECT column1, column2, n, {S('correlation')} AS correlation, {_strength_sql('correlation')} AS strength,
      {_dir_sql('correlation')} AS direction FROM ({inner}) p"""


def q_corr_pearson(spark, sf):
    return sig(correlate.correlation(_t(spark, sf, "lineitem"), LINE4, "pearson"))


def sql_corr_pearson():
    return _labelled(_pearson_sql("lineitem", LINE4))


WIDE_BASE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WIDE = [f"{c[2:]}_{k}" for k in range(9) for c in WIDE_BASE]


def _wide_terms(k):
    """Column k of each measure: the measure mixed with another column, absent in some rows (none for k = 0)."""
    return [(f"{c[2:]}_{k}", f"{c} * {k + 1} + l_suppkey * {(k * 37) % 11} * 0.001",
             f"(l_orderkey + {i}) % {7 + k} <> 0" if k else "l_orderkey IS NOT NULL") for i, c in enumerate(WIDE_BASE)]


def _wide_sql():
    return ", ".join(f"CASE WHEN {cond} THEN CAST({e} AS DOUBLE) END AS {name}" for k in range(9) for name, e, cond in _wide_terms(k))


def q_corr_wide(spark, sf):
    wide = _t(spark, sf, "lineitem").selectExpr(*[f"CASE WHEN {cond} THEN CAST({e} AS DOUBLE) END AS {name}"
                                                 for k in range(9) for name, e, cond in _wide_terms(k)])
    return sig(correlate.correlation(wide, WIDE))


def sql_corr_wide():
    cells = ", ".join(f"struct_pack(column1 := '{a}', column2 := '{b}', n := count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL),"
                      f" correlation := corr({a}, {b}))" for a, b in _pairs(WIDE))
    return _labelled(f"SELECT p.column1, p.column2, p.n, p.correlation FROM (SELECT unnest([{cells}]) AS p FROM (SELECT {_wide_sql()} FROM lineitem) w) u")


def q_corr_spearman(spark, sf):
    return sig(correlate.correlation(_t(spark, sf, "lineitem"), LINE4, "spearman"))


def sql_corr_spearman():
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LINE4)
    return _labelled(_pearson_sql(f"(SELECT {ranks} FROM lineitem) r", LINE4))


def _line_gaps(spark, sf):
    return _t(spark, sf, "lineitem").select(
        "l_quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_extendedprice")).alias("l_extendedprice"))


GAPS3 = ["l_quantity", "l_discount", "l_extendedprice"]


def q_corr_spearman_gaps(spark, sf):
    return sig(correlate.correlation(_line_gaps(spark, sf), GAPS3, "spearman"))


def sql_corr_spearman_gaps():
    src = """(SELECT l_quantity, CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END AS l_discount,
      CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice END AS l_extendedprice FROM lineitem)"""
    parts = []
    for a, b in _pairs(GAPS3):
        ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in (a, b))
        parts.append(_pearson_sql(f"(SELECT {ranks} FROM {src} x WHERE {a} IS NOT NULL AND {b} IS NOT NULL) r", [a, b]))
    return _labelled(" UNION ALL ".join(parts))


def q_corr_kendall_lineitem(spark, sf):
    return sig(kendall.kendall_pairs(_t(spark, sf, "lineitem"), [("l_quantity", "l_discount")]).select(
        "column1", "column2", "n", *[F.col(c).cast("long").alias(c) for c in ("concordant", "discordant", "ties_x", "ties_y", "ties_xy")],
        "tau_b"))


def sql_corr_kendall_lineitem():
    return f"""WITH c AS (SELECT l_quantity AS x, l_discount AS y, CAST(count(*) AS HUGEINT) AS w FROM lineitem
              WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1, 2),
      p AS (SELECT sum(CASE WHEN a.x < b.x AND a.y < b.y THEN a.w * b.w ELSE 0 END) AS con,
                   sum(CASE WHEN a.x < b.x AND a.y > b.y THEN a.w * b.w ELSE 0 END) AS dis FROM c a, c b),
      t AS (SELECT (SELECT sum(w) FROM c) AS n, (SELECT sum(k * (k - 1) // 2) FROM (SELECT sum(w) AS k FROM c GROUP BY x)) AS tx,
              (SELECT sum(k * (k - 1) // 2) FROM (SELECT sum(w) AS k FROM c GROUP BY y)) AS ty, (SELECT sum(w * (w - 1) // 2) FROM c) AS txy)
      SELECT 'l_quantity' AS column1, 'l_discount' AS column2, CAST(n AS BIGINT) AS n, CAST(con AS BIGINT) AS concordant,
        CAST(dis AS BIGINT) AS discordant, CAST(tx AS BIGINT) AS ties_x, CAST(ty AS BIGINT) AS ties_y, CAST(txy AS BIGINT) AS ties_xy,
        {S('CAST(con - dis AS DOUBLE) / sqrt(CAST(n * (n - 1) // 2 - tx AS DOUBLE) * CAST(n * (n - 1) // 2 - ty AS DOUBLE))')} AS tau_b FROM p, t"""


CUST3 = ["c_custkey", "c_nationkey", "c_acctbal"]


def q_corr_kendall(spark, sf):
    return sig(correlate.correlation(_t(spark, sf, "customer"), CUST3, "kendall"))


def sql_corr_kendall():
    parts = []
    for a, b in _pairs(CUST3):
        parts.append(f"""
SELECT '{a}' AS column1, '{b}' AS column2, (SELECT count(*) FROM customer) AS n,
  (sum(CASE WHEN sign(x.a - y.a) * sign(x.b - y.b) > 0 THEN 1 ELSE 0 END)
   - sum(CASE WHEN sign(x.a - y.a) * sign(x.b - y.b) < 0 THEN 1 ELSE 0 END))
  / sqrt((count(*) - sum(CASE WHEN x.a = y.a THEN 1 ELSE 0 END)) * (count(*) - sum(CASE WHEN x.b = y.b THEN 1 ELSE 0 END)) * 1.0) AS correlation
FROM (SELECT {a} AS a, {b} AS b, row_number() OVER () AS id FROM customer) x
JOIN (SELECT {a} AS a, {b} AS b, row_number() OVER () AS id FROM customer) y ON x.id < y.id""")
    return _labelled(" UNION ALL ".join(parts))


def q_corr_matrix(spark, sf):
    return sig(correlate.correlation_matrix(_t(spark, sf, "lineitem"), LINE4))


def sql_corr_matrix():
    p = _pearson_sql("lineitem", LINE4)
    diag = " UNION ALL ".join(
        f"SELECT '{c}' AS column1, '{c}' AS column2, CASE WHEN stddev_pop({c}) > 0 THEN 1.0 END AS correlation FROM lineitem" for c in LINE4)
    return f"""WITH p AS ({p}) SELECT column1, column2, {S('correlation')} AS correlation FROM p
      UNION ALL SELECT column2, column1, {S('correlation')} FROM p UNION ALL SELECT column1, column2, correlation FROM ({diag}) d"""


def q_corr_top_pairs(spark, sf):
    return sig(correlate.top_pairs(correlate.correlation(_t(spark, sf, "lineitem"), LINE8, "pearson"), 10))


def sql_corr_top_pairs():
    return f"""SELECT * FROM ({_labelled(_pearson_sql('lineitem', LINE8))}) t WHERE correlation IS NOT NULL
      ORDER BY abs(correlation) DESC, column1, column2 LIMIT 10"""


def q_corr_summary(spark, sf):
    return correlate.corr_summary(correlate.correlation(_t(spark, sf, "lineitem"), LINE8, "pearson"))


def sql_corr_summary():
    lab = _labelled(_pearson_sql("lineitem", LINE8))
    return f"""WITH p AS (SELECT * FROM ({lab}) t WHERE correlation IS NOT NULL),
      b AS (SELECT * FROM p ORDER BY abs(correlation) DESC, column1, column2 LIMIT 1)
      SELECT (SELECT count(*) FROM p) AS total_pairs,
             (SELECT count(*) FROM p WHERE abs(correlation) >= 0.6) AS strong_correlations,
             (SELECT count(*) FROM p WHERE abs(correlation) >= 0.4 AND abs(correlation) < 0.6) AS moderate_correlations,
             CASE WHEN (SELECT count(*) FROM p) = 0 THEN 'No significant correlations found.' ELSE
             (SELECT printf('Strongest correlation is between %s and %s (r = %.3f, %s %s correlation).',
                     column1, column2, round_even(correlation, 3), strength, direction) FROM b) END AS interpretation"""


# ---------------------------------------------------------------- outliers
EVENTS3 = ["event_id", "user_id", "value"]


def _fences_sql(table, cols):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS col, count({c}) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
        avg({c}) AS mean, stddev_pop({c}) AS sdp FROM {table}""" for c in cols)


def _flags_sql(table, cols):
    vals = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM {table} WHERE {c} IS NOT NULL" for c in cols)
    return f"""WITH f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM ({_fences_sql(table, cols)}) x),
      v AS ({vals}),
      j AS (SELECT v.col, v.v, f.n, f.lo, f.hi, (v.v < f.lo OR v.v > f.hi) AS iqr_flag,
              CASE WHEN f.sdp > 0 THEN abs((v.v - f.mean) / f.sdp) END AS z FROM v JOIN f USING (col))"""


def _values_text(column):
    """An array of doubles as text (ten-thousandths, the same arithmetic as ``_VALUES_SQL``)."""
    return F.concat_ws(",", F.transform(column, lambda v: F.floor(v * 10000 + 0.5).cast("bigint").cast("string")))


_VALUES_SQL = "CAST(CAST(floor(v * 10000 + 0.5) AS BIGINT) AS VARCHAR)"


def _first_values_sql():
    """t: the first ten flagged values of each column and method as text."""
    return f""", u AS (SELECT col, 'iqr' AS method, v, greatest(lo - v, v - hi) AS d FROM j WHERE iqr_flag
              UNION ALL SELECT col, 'zscore', v, z FROM j WHERE z > 3),
      r AS (SELECT col, method, v, row_number() OVER (PARTITION BY col, method ORDER BY d DESC, v ASC) AS rk FROM u),
      t AS (SELECT col, method, string_agg({_VALUES_SQL}, ',' ORDER BY rk) AS vals FROM r WHERE rk <= 10 GROUP BY col, method)"""


def q_outliers_iqr(spark, sf):
    o = outliers.outliers(_t(spark, sf, "events"), EVENTS3, ["iqr"])
    return sig(o).withColumn("outlier_values", _values_text("outlier_values"))


def sql_outliers_iqr():
    return _flags_sql("events", EVENTS3) + _first_values_sql() + f"""
      SELECT col AS "column", 'iqr' AS method, count(*) FILTER (WHERE iqr_flag) AS count,
        {S('count(*) FILTER (WHERE iqr_flag) * 100.0 / max(n)')} AS percentage, {S('max(lo)')} AS lower_bound,
        {S('max(hi)')} AS upper_bound, CAST(NULL AS DOUBLE) AS threshold,
        coalesce(max((SELECT vals FROM t WHERE t.col = j.col AND t.method = 'iqr')), '') AS outlier_values FROM j GROUP BY col"""


def q_outliers_zscore(spark, sf):
    o = outliers.outliers(_t(spark, sf, "events"), EVENTS3, ["zscore"])
    return sig(o.select("column", "method", "count", "percentage", "threshold"))


def sql_outliers_zscore():
    return _flags_sql("events", EVENTS3) + f"""
      SELECT col AS "column", 'zscore' AS method, count(*) FILTER (WHERE z > 3) AS count,
        {S('count(*) FILTER (WHERE z > 3) * 100.0 / max(n)')} AS percentage, CAST(3.0 AS DOUBLE) AS threshold FROM j GROUP BY col"""


def q_outliers_both(spark, sf):
    o = outliers.outliers(_t(spark, sf, "orders"), ["o_totalprice"])
    return sig(o).withColumn("outlier_values", _values_text("outlier_values"))


def sql_outliers_both():
    vals = "coalesce(max((SELECT vals FROM t WHERE t.col = j.col AND t.method = '{m}')), '') AS outlier_values"
    return _flags_sql("orders", ["o_totalprice"]) + _first_values_sql() + f"""
      SELECT col AS "column", 'iqr' AS method, count(*) FILTER (WHERE iqr_flag) AS count,
        {S('count(*) FILTER (WHERE iqr_flag) * 100.0 / max(n)')} AS percentage, {S('max(lo)')} AS lower_bound, {S('max(hi)')} AS upper_bound,
        CAST(NULL AS DOUBLE) AS threshold, {vals.format(m='iqr')} FROM j GROUP BY col
      UNION ALL SELECT col, 'zscore', count(*) FILTER (WHERE z > 3), {S('count(*) FILTER (WHERE z > 3) * 100.0 / max(n)')},
        NULL, NULL, CAST(3.0 AS DOUBLE), {vals.format(m='zscore')} FROM j GROUP BY col"""


def q_outlier_rows(spark, sf):
    return sig(outliers.outlier_values(_t(spark, sf, "events"), ["value"], ["iqr", "zscore"], 10))


def sql_outlier_rows():
    return _flags_sql("events", ["value"]) + f"""
      , u AS (SELECT col, 'iqr' AS method, v, greatest(lo - v, v - hi) AS d FROM j WHERE iqr_flag
              UNION ALL SELECT col, 'zscore', v, z FROM j WHERE z > 3),
      r AS (SELECT col, method, v, row_number() OVER (PARTITION BY col, method ORDER BY d DESC, v ASC) AS rk FROM u)
      SELECT col AS "column", method, rk AS rank, {S('v')} AS value FROM r WHERE rk <= 10"""


def q_outlier_records(spark, sf):
    r = outliers.outlier_rows(_t(spark, sf, "events"), "value", "iqr")
    return sig(r.select("event_id", "user_id", "value", "score"))


def sql_outlier_records():
    return _flags_sql("events", ["value"]) + f"""
      SELECT e.event_id, e.user_id, {S('e.value')} AS value, {S('greatest(f.lo - e.value, e.value - f.hi)')} AS score
      FROM events e, f WHERE e.value IS NOT NULL AND (e.value < f.lo OR e.value > f.hi)"""


def q_outlier_records_z(spark, sf):
    r = outliers.outlier_rows(_t(spark, sf, "events"), "value", "zscore")
    return sig(r.select("event_id", "value", "score"))


def sql_outlier_records_z():
    return f"""WITH f AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
      SELECT event_id, {S('value')} AS value, {S('abs((value - m) / s)')} AS score
      FROM events, f WHERE value IS NOT NULL AND s > 0 AND abs((value - m) / s) > 3"""


def q_outlier_summary(spark, sf):
    return sig(outliers.outlier_summary(_t(spark, sf, "events"), ["value"]))


def sql_outlier_summary():
    return _flags_sql("events", ["value"]) + """
      , c AS (SELECT col, 'iqr' AS method, count(*) FILTER (WHERE iqr_flag) AS count,
                count(*) FILTER (WHERE iqr_flag) * 100.0 / max(n) AS pct FROM j GROUP BY col
              UNION ALL SELECT col, 'zscore', count(*) FILTER (WHERE z > 3), count(*) FILTER (WHERE z > 3) * 100.0 / max(n)
              FROM j GROUP BY col)
      SELECT col AS "column", method, count, CAST(sum(count) OVER () AS BIGINT) AS total_outliers,
        printf('%s: %d outliers (%.1f%%)', upper(method), count, round_even(pct, 1)) AS summary FROM c"""


# ---------------------------------------------------------------- distribution
def _shape_sql(table, cols):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)) AS s,
        kurtosis_pop({c}) AS k, min({c}) AS mn FROM {table}""" for c in cols)


def _skew_label(s):
    return (f"CASE WHEN abs({s}) < 0.5 THEN 'approximately symmetric' WHEN {s} > 0 THEN 'right-skewed (positive skew)' "
            f"WHEN {s} IS NOT NULL THEN 'left-skewed (negative skew)' END")


def _kurt_label(k):
    return (f"CASE WHEN abs({k}) < 0.5 THEN 'normal tail behavior (mesokurtic)' WHEN {k} > 0 THEN 'heavy tails (leptokurtic)' "
            f"WHEN {k} IS NOT NULL THEN 'light tails (platykurtic)' END")


def q_distribution_shape(spark, sf):
    d = distribution.distribution(_t(spark, sf, "lineitem"), LINE4)
    return sig(d.select("column", "n", "skewness", "kurtosis", "skew_label", "kurt_label"))


def sql_distribution_shape():
    return f"""SELECT "column", n, {S('s')} AS skewness, {S('k')} AS kurtosis, {_skew_label('s')} AS skew_label,
      {_kurt_label('k')} AS kurt_label FROM ({_shape_sql('lineitem', LINE4)}) t"""


def q_distribution_type(spark, sf):
    d = distribution.distribution(_t(spark, sf, "events"), EVENTS3)
    return sig(d)


def sql_distribution_type():
    return f"""SELECT "column", n, {S('s')} AS skewness, {S('k')} AS kurtosis, {S('mn')} AS min, {_skew_label('s')} AS skew_label,
      {_kurt_label('k')} AS kurt_label, {_type_sql('s', 'k', 'mn')} AS distribution_type FROM ({_shape_sql('events', EVENTS3)}) t"""


LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


def q_normality_shapiro(spark, sf):
    return sig(normality.normality(_t(spark, sf, "lineitem"), LINE4, key=LINE_KEY))


# Wichura's algorithm AS 241 (numerator and denominator, highest power first) for the
# central part and the tail, and Royston's AS R94 polynomials (lowest power first).
AS241_CENTRE = (["2509.0809287301226727", "33430.575583588128105", "67265.770927008700853", "45921.953931549871457",
                 "13731.693765509461125", "1971.5909503065514427", "133.14166789178437745", "3.387132872796366608"],
                ["5226.495278852854561", "28729.085735721942674", "39307.89580009271061", "21213.794301586595867",
                 "5394.1960214247511077", "687.1870074920579083", "42.313330701600911252", "1.0"])
AS241_TAIL = (["0.000774545014278341407640", "0.0227238449892691845833", "0.241780725177450611770", "1.27045825245236838258",
               "3.64784832476320460504", "5.76949722146069140550", "4.63033784615654529590", "1.42343711074968357734"],
              ["0.00000000105075007164441684324", "0.000547593808499534494600", "0.0151986665636164571966", "0.148103976427480074590",
               "0.689767334985100004550", "1.67638483018380384940", "2.05319162663775882187", "1.0"])
ROYSTON = {"c1": [0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056], "c2": [0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633],
           "mu": [-1.5861, -0.31082, -0.083751, 0.0038915], "sd": [-0.4803, -0.082676, 0.0030302]}


def _horner(coefficients, x):
    out = str(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out}) * {x} + ({c})"
    return f"({out})"


def _shapiro_sql(table, cols, key):
    """CTEs down to w(col, n, total, w, p): AS R94 for samples of 12 values or more."""
    ks = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    picked = " UNION ALL ".join(
        f"""SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v, row_number() OVER (ORDER BY substr(md5(concat_ws('|', '42', {ks})), 1, 15), {c}) AS r,
        count(*) OVER () AS total FROM {table} WHERE {c} IS NOT NULL""" for c in cols)
    centre = f"(pr - 0.5) * {_horner(AS241_CENTRE[0], 'rc')} / {_horner(AS241_CENTRE[1], 'rc')}"
    tail = f"-{_horner(AS241_TAIL[0], 'rt')} / {_horner(AS241_TAIL[1], 'rt')}"
    poly = lambda k, x: _horner(list(reversed(ROYSTON[k])), x)
    return f"""pick AS (SELECT col, v, total, row_number() OVER (PARTITION BY col ORDER BY v) AS i,
              count(*) OVER (PARTITION BY col) AS n FROM ({picked}) q WHERE r <= 5000),
      pr AS (SELECT col, i, n, (i - 0.375) / (n + 0.25) AS pr FROM pick WHERE i <= n // 2),
      r2 AS (SELECT *, 0.180625 - (pr - 0.5) * (pr - 0.5) AS rc, sqrt(-ln(pr)) - 1.6 AS rt FROM pr),
      m AS (SELECT col, i, n, CASE WHEN abs(pr - 0.5) <= 0.425 THEN {centre} ELSE {tail} END AS m FROM r2),
      t AS (SELECT col, n, 2 * sum(m * m) AS s2, max(CASE WHEN i = 1 THEN m END) AS m1, max(CASE WHEN i = 2 THEN m END) AS m2,
              1 / sqrt(n) AS rn FROM m GROUP BY col, n),
      a1 AS (SELECT *, {poly('c1', 'rn')} - m1 / sqrt(s2) AS a1, {poly('c2', 'rn')} - m2 / sqrt(s2) AS a2 FROM t),
      fac AS (SELECT *, sqrt((s2 - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS f FROM a1),
      b AS (SELECT m.col, sum(CASE m.i WHEN 1 THEN a1 WHEN 2 THEN a2 ELSE -m.m / f END * (hi.v - lo.v)) AS b
            FROM m JOIN fac USING (col) JOIN pick lo ON lo.col = m.col AND lo.i = m.i
              JOIN pick hi ON hi.col = m.col AND hi.i = m.n + 1 - m.i GROUP BY m.col),
      q AS (SELECT col, max(n) AS n, max(total) AS total, var_pop(v) * max(n) AS ssq FROM pick GROUP BY col),
      w0 AS (SELECT q.col, n, total, b * b / ssq AS w, ln(n) AS ln FROM q JOIN b USING (col)),
      z AS (SELECT *, (ln(1 - w) - {poly('mu', 'ln')}) / exp({poly('sd', 'ln')}) AS z FROM w0),
      zz AS (SELECT *, least(10.0, 45.0 / greatest(abs(z), 4.5)) / 4000 AS h FROM z),
      tl AS (SELECT col, n, total, w, z, exp(-z * z / 2) / sqrt(2 * pi()) * h / 3 * sum(CASE WHEN i = 0 OR i = 4000 THEN 1
               WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-abs(z) * i * h - i * h * i * h / 2)) AS t
             FROM zz, range(0, 4001) g(i) GROUP BY col, n, total, w, z, h),
      w AS (SELECT col, n, total, w, CASE WHEN z >= 0 THEN t ELSE 1 - t END AS p FROM tl)"""


def sql_normality_shapiro():
    return f"""WITH {_shapiro_sql('lineitem', LINE4, LINE_KEY)}
      SELECT col AS "column", {S('w')} AS statistic, {S('p')} AS p_value, p > 0.05 AS is_normal, n AS sample_size_used, total AS n FROM w"""


def q_distribution_report(spark, sf):
    return sig(distribution.distribution_report(_t(spark, sf, "lineitem"), LINE4, key=LINE_KEY))


def _type_sql(s, k, mn):
    return f"""CASE WHEN abs({s}) < 0.5 AND abs({k}) < 0.5 THEN 'Normal distribution'
           WHEN abs({s}) > 1 THEN 'Exponential or Log-normal distribution'
           WHEN {mn} >= 0 AND abs({s}) > 0.5 THEN 'Gamma or Weibull distribution'
           ELSE 'Non-standard distribution' END"""


def sql_distribution_report():
    return f"""WITH {_shapiro_sql('lineitem', LINE4, LINE_KEY)}, d AS ({_shape_sql('lineitem', LINE4)}),
      l AS (SELECT d."column", d.n, d.s, d.k, {_skew_label('d.s')} AS sl, {_kurt_label('d.k')} AS kl, {_type_sql('d.s', 'd.k', 'd.mn')} AS ty,
              w.w, w.p, w.n AS used FROM d JOIN w ON w.col = d."column")
      SELECT "column", n, {S('s')} AS skewness, {S('k')} AS kurtosis, sl AS skew_label, kl AS kurt_label, ty AS distribution_type,
        {S('w')} AS statistic, {S('p')} AS p_value, p > 0.05 AS is_normal, used AS sample_size_used,
        printf('Distribution analysis for ''%s'': %s distribution (Shapiro-Wilk p-value: %.4f). Shape: %s, %s. Suggested type: %s',
          "column", CASE WHEN p > 0.05 THEN 'Normal' ELSE 'Non-normal' END, round_even(p, 4), sl, kl, ty) AS interpretation FROM l"""


def q_histogram(spark, sf):
    return sig(distribution.histogram(_t(spark, sf, "lineitem"), "l_extendedprice", 10))


def sql_histogram():
    return f"""WITH s AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem),
      i AS (SELECT l_extendedprice AS x, mn, CAST(least(floor((l_extendedprice - mn) * (10.0 / (mx - mn))), 9) AS INTEGER) AS i1,
              (mx - mn) / 10.0 AS w FROM lineitem, s WHERE l_extendedprice IS NOT NULL),
      b AS (SELECT CASE WHEN x < mn + i1 * w THEN i1 - 1 WHEN x >= mn + (i1 + 1) * w AND i1 <> 9 THEN i1 + 1 ELSE i1 END AS bin
            FROM i),
      c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
      g AS (SELECT CAST(i AS INTEGER) AS bin FROM range(0, 10) t(i))
      SELECT g.bin, {S('mn + g.bin * ((mx - mn) / 10.0)')} AS lo, {S('mn + (g.bin + 1) * ((mx - mn) / 10.0)')} AS hi,
        coalesce(c.count, 0) AS count FROM g CROSS JOIN s LEFT JOIN c USING (bin)"""


def q_distribution_by_group(spark, sf):
    return sig(distribution.distribution_by_group(_t(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


def sql_distribution_by_group():
    x = "l_extendedprice"
    return f"""SELECT l_returnflag, count({x}) AS n, {S(f'min({x})')} AS min, {S(f'quantile_cont({x}, 0.25)')} AS q1,
      {S(f'quantile_cont({x}, 0.5)')} AS median, {S(f'quantile_cont({x}, 0.75)')} AS q3, {S(f'max({x})')} AS max,
      {S(f'avg({x})')} AS mean FROM lineitem WHERE l_returnflag IS NOT NULL AND {x} IS NOT NULL GROUP BY l_returnflag"""


# ---------------------------------------------------------------- categorical
ORD2 = ["o_orderstatus", "o_orderpriority"]
PART3 = ["p_name", "p_brand", "p_type"]


def _vc_sql(table, cols):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}"""
        for c in cols)


def q_value_counts(spark, sf):
    return categorical.value_counts(_t(spark, sf, "orders"), ORD2)


def sql_value_counts():
    return f"""SELECT col AS "column", value, count, row_number() OVER (PARTITION BY col ORDER BY count DESC, value ASC) AS rank
      FROM ({_vc_sql('orders', ORD2)}) v"""


def q_categorical_profile(spark, sf):
    return sig(categorical.categorical(_t(spark, sf, "orders"), ORD2))


def sql_categorical_profile():
    miss = " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) - count({c}) AS m FROM orders" for c in ORD2)
    return f"""WITH v AS ({_vc_sql('orders', ORD2)}),
      t AS (SELECT col, value, count, row_number() OVER (PARTITION BY col ORDER BY count DESC, value ASC) AS rk FROM v),
      a AS (SELECT col, count(*) AS u, sum(count) AS nn, -sum(count * 1.0 / sum_c * ln(count * 1.0 / sum_c)) AS ent
            FROM (SELECT *, sum(count) OVER (PARTITION BY col) AS sum_c FROM v) x GROUP BY col)
      SELECT m.col AS "column", a.u AS unique_values, t.value AS top_value, t.count AS top_count,
        {S('t.count * 100.0 / a.nn')} AS top_percentage, {S('a.ent')} AS entropy, m.m AS missing_values
      FROM ({miss}) m JOIN a USING (col) JOIN t ON t.col = m.col AND t.rk = 1"""


def q_categorical_top10(spark, sf):
    return categorical.categorical_top(_t(spark, sf, "part"), PART3, 10)


def sql_categorical_top10():
    return f"""SELECT * FROM (SELECT col AS "column", value, count,
      row_number() OVER (PARTITION BY col ORDER BY count DESC, value ASC) AS rank FROM ({_vc_sql('part', PART3)}) v) t WHERE rank <= 10"""


def q_categorical_summary(spark, sf):
    return categorical.categorical_summary(_t(spark, sf, "part"), PART3)


def sql_categorical_summary():
    return f"""WITH v AS ({_vc_sql('part', PART3)}),
      t AS (SELECT col, value, count, row_number() OVER (PARTITION BY col ORDER BY count DESC, value ASC) AS rk,
              count(*) OVER (PARTITION BY col) AS u, sum(count) OVER (PARTITION BY col) AS nn FROM v)
      SELECT col AS "column", u AS unique_values, CAST(sum(u) OVER () AS BIGINT) AS total_categories,
        printf('Categorical analysis for ''%s'': %d unique values, most frequent: ''%s'' (%.1f%%)', col, u, value,
          round_even(count * 100.0 / nn, 1)) AS summary
      FROM t WHERE rk = 1"""


# ---------------------------------------------------------------- hypothesis tests
def _tp_cte(src):
    """Two-sided p of Pearson r (columns r, n of ``src``) by Simpson's rule:
    p = 2 / B(1/2, d/2) * int_th^(pi/2) cos^(d-1), th = atan(|t| / sqrt(d))."""
    return f"""a AS (SELECT r, n, n - 2 AS d, atan(abs(r) * sqrt((n - 2) / (1 - r * r)) / sqrt(n - 2.0)) AS th FROM {src}),
      b AS (SELECT *, (pi() / 2 - th) / 20000 AS h FROM a),
      p AS (SELECT r, n, 2.0 / exp(lgamma(0.5) + lgamma(d / 2.0) - lgamma((d + 1) / 2.0)) * h / 3.0 *
              sum(CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END *
                  exp((d - 1) * ln(greatest(cos(th + i * h), 1e-300)))) AS p
            FROM b, range(0, 20001) t(i) GROUP BY r, n, d, th, h)"""


def q_pearson_test(spark, sf):
    t = inference.pearson_test(_t(spark, sf, "lineitem"), "l_quantity", "l_discount")
    return _whole(t)


def _recs_sql(p, test):
    rec = {"Pearson Correlation": "Consider investigating the relationship further with regression analysis",
           "One-way ANOVA": "Consider post-hoc tests to identify which groups differ significantly",
           "Chi-square Test of Independence": "Examine the contingency table to understand the nature of the association"}[test]
    return (f"CASE WHEN {p} < 0.05 THEN 'The test result is statistically significant (p < 0.05) | {rec}' ELSE "
            f"'The test result is not statistically significant (p >= 0.05) | There is insufficient evidence to reject the null hypothesis' END")


def sql_pearson_test():
    r = "corr(l_quantity, l_discount)"
    n = "count(*)"
    return f"""WITH s AS (SELECT {r} AS r, {n} AS n FROM lineitem), {_tp_cte('s')}
      SELECT 'Pearson Correlation' AS test_type, 'l_quantity,l_discount' AS variables, {S('r')} AS statistic, {S('p')} AS p_value,
        n - 2 AS df1, CAST(NULL AS BIGINT) AS df2, n, p < 0.05 AS is_significant,
        (CASE WHEN p < 0.05 THEN 'Significant ' ELSE 'Non-significant ' END) || lower({_strength_sql('r')}) || ' correlation' AS interpretation,
        {_recs_sql('p', 'Pearson Correlation')} AS recommendations FROM p"""


def _whole(t):
    """A test's whole result row, arrays as text."""
    t = t.withColumn("variables", F.concat_ws(",", "variables")).withColumn("recommendations", F.concat_ws(" | ", "recommendations"))
    return sig(t)


def q_anova_test(spark, sf):
    return _whole(inference.anova_test(_t(spark, sf, "lineitem"), "l_quantity", "l_returnflag"))


def sql_anova_test():
    # three groups (d1 = 2): P(F > f) = (d2 / (d2 + 2 f))^(d2 / 2) exactly
    return f"""WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v
              FROM lineitem WHERE l_returnflag IS NOT NULL AND l_quantity IS NOT NULL GROUP BY l_returnflag),
      t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm FROM g),
      s AS (SELECT t.k, t.n, sum(g.n * (g.m - t.gm) * (g.m - t.gm)) AS ssb, sum(coalesce((g.n - 1) * g.v, 0)) AS ssw
            FROM g, t GROUP BY t.k, t.n),
      f AS (SELECT k, n, k - 1 AS df1, n - k AS df2, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM s),
      p AS (SELECT *, power((df2 * 1.0) / (df2 + 2 * f), df2 / 2.0) AS p FROM f)
      SELECT 'One-way ANOVA' AS test_type, 'l_quantity,l_returnflag' AS variables, {S('f')} AS statistic, {S('p')} AS p_value, df1,
        CAST(df2 AS BIGINT) AS df2, CAST(n AS BIGINT) AS n, p < 0.05 AS is_significant,
        CASE WHEN p < 0.05 THEN 'Significant' ELSE 'Non-significant' END || ' difference between groups' AS interpretation,
        {_recs_sql('p', 'One-way ANOVA')} AS recommendations, k AS groups FROM p"""


def q_anova_groups(spark, sf):
    return sig(inference.anova_groups(_t(spark, sf, "lineitem"), "l_quantity", "l_returnflag"))


def sql_anova_groups():
    return f"""SELECT l_returnflag AS "group", count(*) AS n, {S('avg(l_quantity)')} AS mean, {S('var_samp(l_quantity)')} AS var
      FROM lineitem WHERE l_returnflag IS NOT NULL AND l_quantity IS NOT NULL GROUP BY l_returnflag"""


def _chi_sql(table, a, b):
    return f"""WITH c AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM {table}
                WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
      r AS (SELECT a, sum(o) AS rs FROM c GROUP BY a), k AS (SELECT b, sum(o) AS cs FROM c GROUP BY b),
      n AS (SELECT sum(o) AS n, (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM k) AS nc FROM c),
      grid AS (SELECT r.a, k.b, r.rs * k.cs * 1.0 / n.n AS e, coalesce(c.o, 0) AS o, n.nr, n.nc
               FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b),
      x AS (SELECT max(nr) AS nr, max(nc) AS nc,
              sum(CASE WHEN nr = 2 AND nc = 2 THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) / e
                       ELSE (o - e) * (o - e) / e END) AS chi2 FROM grid)"""


def q_chi_square_test(spark, sf):
    return _whole(inference.chi_square_test(_t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


def sql_chi_square_test():
    # 3 x 2 table: dof 2, upper tail exp(-x/2)
    return _chi_row("lineitem", "l_returnflag", "l_linestatus", "exp(-chi2 / 2)")


def _chi_row(table, a, b, p):
    return _chi_sql(table, a, b) + f"""
      SELECT 'Chi-square Test of Independence' AS test_type, '{a},{b}' AS variables, {S('chi2')} AS statistic, {S(p)} AS p_value,
        (nr - 1) * (nc - 1) AS df1, CAST(NULL AS BIGINT) AS df2, CAST((SELECT n FROM n) AS BIGINT) AS n, {p} < 0.05 AS is_significant,
        CASE WHEN {p} < 0.05 THEN 'Significant' ELSE 'Non-significant' END || ' association between variables' AS interpretation,
        {_recs_sql(p, 'Chi-square Test of Independence')} AS recommendations FROM x"""


def q_chi_square_2x2(spark, sf):
    return _whole(inference.chi_square_test(_t(spark, sf, "labels"), "quality", "toxic"))


def sql_chi_square_2x2():
    # dof 1 with the continuity correction; p = 1 - 2 * int_0^sqrt(x) phi (Simpson)
    p = """(SELECT 1 - 2 * (sqrt(x.chi2) / 2000) / 3 * sum(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
              * exp(-power(i * sqrt(x.chi2) / 2000, 2) / 2) / sqrt(2 * pi())) FROM range(0, 2001) t(i))"""
    return _chi_row("labels", "quality", "toxic", p)


def q_crosstab(spark, sf):
    return inference.crosstab(_t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


def sql_crosstab():
    return """SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders
      WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2"""


def q_chi_square_wide(spark, sf):
    return _whole(inference.chi_square_test(_t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


def sql_chi_square_wide():
    # 3 x 5 table: dof 8, upper tail e^(-x/2) * sum_{i<4} (x/2)^i / i!
    return _chi_row("orders", "o_orderstatus", "o_orderpriority", _TAIL8)


_TAIL8 = "exp(-chi2 / 2) * (1 + chi2 / 2 + power(chi2 / 2, 2) / 2 + power(chi2 / 2, 3) / 6)"


def _cut(sql):
    """The columns of ``hypothesis_test`` from a test's own oracle."""
    return "SELECT " + ", ".join(inference.RESULT_COLUMNS) + f" FROM ({sql}) cut"


def q_hypothesis_auto(spark, sf):
    return _whole(inference.hypothesis_test(_t(spark, sf, "lineitem"), "l_returnflag", "l_quantity"))


def sql_hypothesis_auto():
    return _cut(sql_anova_test())


def q_hypothesis_auto_pearson(spark, sf):
    return _whole(inference.hypothesis_test(_t(spark, sf, "lineitem"), "l_quantity", "l_discount"))


def sql_hypothesis_auto_pearson():
    return _cut(sql_pearson_test())


def q_hypothesis_auto_chi(spark, sf):
    return _whole(inference.hypothesis_test(_t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))


def sql_hypothesis_auto_chi():
    return _cut(sql_chi_square_wide())


def q_hypothesis_explicit(spark, sf):
    """Every explicit type, one row each."""
    li = _t(spark, sf, "lineitem")
    rows = [inference.hypothesis_test(li, "l_quantity", "l_discount", "correlation"),
            inference.hypothesis_test(li, "l_quantity", "l_returnflag", "anova"),
            inference.hypothesis_test(li, "l_returnflag", "l_linestatus", "chi_square")]
    return _whole(rows[0].unionByName(rows[1]).unionByName(rows[2]))


def sql_hypothesis_explicit():
    return " UNION ALL ".join(_cut(x) for x in (sql_pearson_test(), sql_anova_test(), sql_chi_square_test()))


def q_anova_details(spark, sf):
    """The group list of an ANOVA's result row, one row per group."""
    row = inference.hypothesis_test(_t(spark, sf, "lineitem"), "l_returnflag", "l_quantity", details=True)
    return row.select("groups", F.explode("group_sizes").alias("g"), F.col("contingency").isNull().alias("no_table")).select(
        "groups", "g.group", "g.n", "no_table")


def sql_anova_details():
    return """SELECT count(*) OVER () AS groups, l_returnflag AS "group", count(l_quantity) AS n, true AS no_table
      FROM lineitem WHERE l_returnflag IS NOT NULL AND l_quantity IS NOT NULL GROUP BY l_returnflag"""


def q_chi_square_details(spark, sf):
    """The contingency table of a chi-square result row, one row per cell."""
    row = inference.hypothesis_test(_t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", details=True)
    return row.select(F.explode("contingency").alias("c"), F.col("groups").isNull().alias("no_groups")).select("c.a", "c.b", "c.n", "no_groups")


def sql_chi_square_details():
    return f"SELECT a, b, n, true AS no_groups FROM ({sql_crosstab()}) t"


def q_crosstab_wide(spark, sf):
    return inference.crosstab_wide(_t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


def sql_crosstab_wide():
    return """SELECT l_returnflag AS a, count(*) FILTER (WHERE l_linestatus = 'F') AS "F", count(*) FILTER (WHERE l_linestatus = 'O') AS "O"
      FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1"""


# ---------------------------------------------------------------- ad-hoc
def q_group_aggregate(spark, sf):
    g = adhoc.group_aggregate(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"],
                              {"l_quantity": ["sum", "mean", "count"], "l_extendedprice": ["sum", "mean"]})
    return sig(g)


def sql_group_aggregate():
    return f"""SELECT l_returnflag, l_linestatus, {S('sum(l_quantity)')} AS sum_l_quantity, {S('avg(l_quantity)')} AS mean_l_quantity,
      count(l_quantity) AS count_l_quantity, {S('sum(l_extendedprice)')} AS sum_l_extendedprice,
      {S('avg(l_extendedprice)')} AS mean_l_extendedprice FROM lineitem GROUP BY l_returnflag, l_linestatus"""


def q_compare_groups(spark, sf):
    return sig(adhoc.compare_groups(_t(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


def sql_compare_groups():
    return f"""SELECT o_orderpriority, count(*) AS n, {S('avg(o_totalprice)')} AS mean,
      {S('avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders WHERE o_totalprice IS NOT NULL)')} AS diff_from_overall
      FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY o_orderpriority"""


def q_filter_rows(spark, sf):
    f = adhoc.filter_rows(_t(spark, sf, "lineitem"), "l_quantity > 45 AND l_discount < 0.02")
    return sig(f.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"))


def sql_filter_rows():
    return f"""SELECT l_orderkey, l_linenumber, {S('l_quantity')} AS l_quantity, {S('l_discount')} AS l_discount,
      {S('l_extendedprice')} AS l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02"""


def q_top_k(spark, sf):
    t = adhoc.top_k(_t(spark, sf, "orders"), "o_totalprice", 5, ["o_orderkey"])
    return sig(t.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"))


def sql_top_k():
    return f"""SELECT o_orderkey, o_custkey, {S('o_totalprice')} AS o_totalprice, o_orderpriority FROM orders
      ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 5"""


def q_preview(spark, sf):
    p = adhoc.preview(_t(spark, sf, "orders"), ["o_orderkey"], 20)
    return sig(p.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))


def sql_preview():
    return f"""SELECT o_orderkey, o_custkey, o_orderstatus, {S('o_totalprice')} AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20"""


def q_adhoc_sql(spark, sf):
    r = adhoc.adhoc_sql(_t(spark, sf, "lineitem"),
                        "SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS avg_price "
                        "FROM quantiva_adhoc_lineitem GROUP BY l_returnflag",
                        view="quantiva_adhoc_lineitem")
    return sig(r)


def sql_adhoc_sql():
    return f"SELECT l_returnflag, count(*) AS n, {S('avg(l_extendedprice)')} AS avg_price FROM lineitem GROUP BY l_returnflag"


# ---------------------------------------------------------------- profiling
DOC3 = ["text", "lang", "source"]


def q_duplicate_records(spark, sf):
    return profile.duplicate_records(_t(spark, sf, "documents").select("text", "lang"))


def sql_duplicate_records():
    return "SELECT text, lang, count(*) AS count FROM documents GROUP BY text, lang HAVING count(*) > 1"


def q_duplicate_rows(spark, sf):
    return profile.duplicate_rows(_t(spark, sf, "documents").select(*DOC3))


def sql_duplicate_rows():
    return "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS BIGINT) AS duplicate_rows FROM documents"


def q_basic_info(spark, sf):
    return sig(profile.basic_info(_t(spark, sf, "customer")))


def sql_basic_info():
    return """SELECT count(*) AS total_rows, CAST(5 AS BIGINT) AS total_columns, CAST(3 AS BIGINT) AS numeric_columns,
      CAST(2 AS BIGINT) AS categorical_columns,
      count(*) * 5 - count(c_custkey) - count(c_name) - count(c_nationkey) - count(c_acctbal) - count(c_mktsegment) AS missing_values,
      CAST(count(c_custkey) * 8 + coalesce(sum(strlen(c_name)), 0) + count(c_nationkey) * 4 + count(c_acctbal) * 8
        + coalesce(sum(strlen(c_mktsegment)), 0) AS BIGINT) AS estimated_bytes,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS duplicate_rows FROM customer"""


def _events_with_gaps(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", "user_id", "event_type",
                    F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
                    F.when(F.col("event_type") != "error", F.col("props")).alias("props"))


EVENTS_GAPS_SQL = """(SELECT event_id, user_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
  CASE WHEN event_type <> 'error' THEN props END AS props FROM events)"""


def q_missing_cells(spark, sf):
    return sig(profile.missing_cells(_events_with_gaps(spark, sf)))


def sql_missing_cells():
    return f"""SELECT count(*) * 5 - count(event_id) - count(user_id) - count(event_type) - count(value) - count(props) AS missing_cells,
      {S('(count(*) * 5 - count(event_id) - count(user_id) - count(event_type) - count(value) - count(props)) * 100.0 / (count(*) * 5)')}
        AS missing_percentage FROM {EVENTS_GAPS_SQL} e"""


def q_estimated_bytes(spark, sf):
    return sig(profile.estimated_bytes(_t(spark, sf, "documents")))


def sql_estimated_bytes():
    e = "count(doc_id) * 8 + coalesce(sum(strlen(text)), 0) + coalesce(sum(strlen(lang)), 0) + coalesce(sum(strlen(source)), 0) + count(n_chars) * 8"
    return f"SELECT CAST({e} AS BIGINT) AS estimated_bytes, {S(f'({e}) / 1024.0 / 1024.0')} AS estimated_mb FROM documents"


LINE_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_TYPES = ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string", "timestamp_ntz"]


def q_schema_overview(spark, sf):
    o = profile.schema_overview(_t(spark, sf, "lineitem"))
    return sig(o.select("column", "dtype", "null_count", "null_percentage", "unique_count", "unique_percentage", "is_numeric"))


def sql_schema_overview():
    parts = []
    for c, t in zip(LINE_ALL, LINE_TYPES):
        num = "true" if t not in ("string", "timestamp_ntz") else "false"
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS null_count,
          {S(f'(count(*) - count({c})) * 100.0 / count(*)')} AS null_percentage, count(DISTINCT {c}) AS unique_count,
          {S(f'count(DISTINCT {c}) * 100.0 / count(*)')} AS unique_percentage, {num} AS is_numeric FROM lineitem""")
    return " UNION ALL ".join(parts)


EVENTS_ALL = ["event_id", "ts", "user_id", "event_type", "value", "props"]
EVENTS_TYPES = ["bigint", "timestamp_ntz", "bigint", "string", "double", "string"]


def q_column_roles(spark, sf):
    return profile.column_roles(_t(spark, sf, "events")).drop("cid")


def sql_column_roles():
    parts = []
    for c, t in zip(EVENTS_ALL, EVENTS_TYPES):
        num = t in ("bigint", "double")
        role = ("'numeric'" if num else "'datetime'" if t.startswith("timestamp")
                else f"CASE WHEN count(DISTINCT {c}) * 1.0 / count(*) < 0.5 THEN 'categorical' ELSE 'text' END")
        src = "events" if role.startswith("CASE") else "(SELECT 1) one"
        parts.append(f"""SELECT '{c}' AS "column", '{t}' AS dtype, {str(num).lower()} AS is_numeric_strict, {role} AS role FROM {src}""")
    return " UNION ALL ".join(parts)


NATION = ["n_nationkey", "n_name", "n_regionkey"]


def q_column_listing(spark, sf):
    cl = profile.column_listing(_t(spark, sf, "nation"), 5)
    return sig(cl.drop("cid").withColumn("sample_values", F.concat_ws(",", "sample_values")))


def sql_column_listing():
    kinds = {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kinds[c]}' AS dtype, (SELECT count(*) - count({c}) FROM nation) AS null_count,
        (SELECT {S(f'(count(*) - count({c})) * 100.0 / count(*)')} FROM nation) AS null_percentage,
        (SELECT count(DISTINCT {c}) FROM nation) AS unique_count,
        (SELECT {S(f'count(DISTINCT {c}) * 100.0 / count(*)')} FROM nation) AS unique_percentage, {str(kinds[c] == 'int').lower()} AS is_numeric,
        (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT CAST({c} AS VARCHAR) AS v FROM nation WHERE {c} IS NOT NULL
           ORDER BY v LIMIT 5)) AS sample_values""" for c in NATION)


def q_column_info(spark, sf):
    ci = profile.column_info(_t(spark, sf, "customer"), "c_mktsegment", 100)
    return sig(ci.withColumns({c: F.concat_ws(",", c) for c in ("unique_values", "sample_values")}))


def sql_column_info():
    return f"""SELECT 'c_mktsegment' AS "column", 'string' AS dtype, count(*) - count(c_mktsegment) AS null_count,
      {S('(count(*) - count(c_mktsegment)) * 100.0 / count(*)')} AS null_percentage, count(DISTINCT c_mktsegment) AS unique_count,
      {S('count(DISTINCT c_mktsegment) * 100.0 / count(*)')} AS unique_percentage, false AS is_numeric,
      (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL
         ORDER BY v LIMIT 100)) AS unique_values,
      (SELECT string_agg(v, ',' ORDER BY rn) FROM (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY c_mktsegment) AS rn
         FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY c_mktsegment LIMIT 10)) AS sample_values FROM customer"""


def q_unique_values(spark, sf):
    return profile.unique_values(_t(spark, sf, "orders"), "o_orderpriority", 100)


def sql_unique_values():
    return "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL ORDER BY value LIMIT 100"


def q_quality_report(spark, sf):
    q = profile.quality_report(_events_with_gaps(spark, sf))
    return sig(q.select("total_rows", "total_columns", "missing_data_percentage", "duplicate_rows",
                        F.concat_ws(",", "columns_with_missing_data").alias("columns_with_missing_data"),
                        F.concat_ws(",", "columns_all_missing").alias("columns_all_missing"),
                        "numeric_columns_count", "categorical_columns_count", "missing_values", "estimated_bytes"))


def sql_quality_report():
    return f"""SELECT count(*) AS total_rows, CAST(5 AS BIGINT) AS total_columns,
      {S('(count(*) * 5 - count(event_id) - count(user_id) - count(event_type) - count(value) - count(props)) * 100.0 / (count(*) * 5)')}
        AS missing_data_percentage,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {EVENTS_GAPS_SQL} d)) AS duplicate_rows,
      concat_ws(',', CASE WHEN count(value) < count(*) THEN 'value' END, CASE WHEN count(props) < count(*) THEN 'props' END)
        AS columns_with_missing_data,
      '' AS columns_all_missing, CAST(3 AS BIGINT) AS numeric_columns_count, CAST(2 AS BIGINT) AS categorical_columns_count,
      count(*) * 5 - count(event_id) - count(user_id) - count(event_type) - count(value) - count(props) AS missing_values,
      CAST(8 * (count(event_id) + count(user_id) + count(value)) + coalesce(sum(strlen(event_type)), 0) + coalesce(sum(strlen(props)), 0)
        AS BIGINT) AS estimated_bytes
      FROM {EVENTS_GAPS_SQL} e"""


def q_column_info_maps(spark, sf):
    m = profile.column_info_maps(_t(spark, sf, "events"))
    return m.select("total_columns", F.concat_ws(",", "numeric_columns").alias("numeric_columns"),
                    F.concat_ws(",", "categorical_columns").alias("categorical_columns"),
                    F.concat_ws(",", "datetime_columns").alias("datetime_columns"),
                    F.concat_ws(",", "text_columns").alias("text_columns"),
                    *[F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))),
                                   ",").alias(c) for c in ("column_types", "missing_values", "unique_counts")])


def sql_column_info_maps():
    listed = lambda f: " || ',' || ".join(f"'{c}=' || CAST({f.format(c=c)} AS VARCHAR)" for c in sorted(EVENTS_ALL))
    kinds = ",".join(f"{c}={t}" for c, t in sorted(zip(EVENTS_ALL, EVENTS_TYPES)))
    return f"""SELECT CAST(6 AS BIGINT) AS total_columns, 'event_id,user_id,value' AS numeric_columns,
      concat_ws(',', CASE WHEN count(DISTINCT event_type) * 1.0 / count(*) < 0.5 THEN 'event_type' END,
                     CASE WHEN count(DISTINCT props) * 1.0 / count(*) < 0.5 THEN 'props' END) AS categorical_columns,
      'ts' AS datetime_columns,
      concat_ws(',', CASE WHEN count(DISTINCT event_type) * 1.0 / count(*) >= 0.5 THEN 'event_type' END,
                     CASE WHEN count(DISTINCT props) * 1.0 / count(*) >= 0.5 THEN 'props' END) AS text_columns,
      '{kinds}' AS column_types, {listed('count(*) - count({c})')} AS missing_values, {listed('count(DISTINCT {c})')} AS unique_counts
      FROM events"""


def q_dataset_context(spark, sf):
    return profile.dataset_context(_t(spark, sf, "customer")).drop("cid")


def sql_dataset_context():
    cols = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", printf('- %s: %s, %.1f%% null, %d unique values', '{c}', '{t}',
          round_even((count(*) - count({c})) * 100.0 / count(*), 1), count(DISTINCT {c})) AS line FROM customer""" for c, t in cols)


def q_analysis_summary(spark, sf):
    from ..operators.summary import analysis_summary
    return sig(analysis_summary(_t(spark, sf, "lineitem")))


def sql_analysis_summary():
    num = LINE8
    cols = ", ".join(LINE_ALL)
    basic = f"""SELECT 'basic' AS section, 'dataset.' || k AS item, v AS value FROM (
        SELECT 'total_rows' AS k, CAST(count(*) AS DOUBLE) AS v FROM lineitem
        UNION ALL SELECT 'total_columns', 11.0 UNION ALL SELECT 'numeric_columns', 8.0
        UNION ALL SELECT 'categorical_columns', 3.0
        UNION ALL SELECT 'missing_values', CAST({' + '.join(f'count(*) - count({c})' for c in LINE_ALL)} AS DOUBLE) FROM lineitem
        UNION ALL SELECT 'duplicate_rows', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM lineitem)) AS DOUBLE)
          FROM lineitem) b"""
    var = " UNION ALL ".join(
        f"""SELECT 'variables', '{c}.' || k, v FROM (SELECT 'mean' AS k, avg({c}) AS v FROM lineitem
            UNION ALL SELECT 'std', stddev_samp({c}) FROM lineitem UNION ALL SELECT 'min', CAST(min({c}) AS DOUBLE) FROM lineitem
            UNION ALL SELECT 'max', CAST(max({c}) AS DOUBLE) FROM lineitem
            UNION ALL SELECT 'missing', CAST(count(*) - count({c}) AS DOUBLE) FROM lineitem
            UNION ALL SELECT 'count', CAST(count({c}) AS DOUBLE) FROM lineitem) x{i}""" for i, c in enumerate(num))
    c0 = num[0]
    out = f"""SELECT 'outliers', '{c0}.' || k, v FROM (
        WITH f AS (SELECT quantile_cont({c0}, 0.25) AS q1, quantile_cont({c0}, 0.75) AS q3, count({c0}) AS n FROM lineitem),
        g AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, n FROM f),
        c AS (SELECT count(*) AS k FROM lineitem, g WHERE {c0} < lo OR {c0} > hi)
        SELECT 'count' AS k, CAST(c.k AS DOUBLE) AS v FROM c UNION ALL SELECT 'percentage', c.k * 100.0 / g.n FROM c, g
        UNION ALL SELECT 'lower_bound', lo FROM g UNION ALL SELECT 'upper_bound', hi FROM g) o"""
    pairs = _pearson_sql("lineitem", num)
    corr = f"""SELECT 'correlation', 'pairs.' || k, v FROM (
        WITH p AS (SELECT * FROM ({pairs}) t WHERE correlation IS NOT NULL)
        SELECT 'total_pairs' AS k, CAST(count(*) AS DOUBLE) AS v FROM p
        UNION ALL SELECT 'strong_correlations', CAST(count(*) FILTER (WHERE abs(correlation) >= 0.6) AS DOUBLE) FROM p) q"""
    schema = " UNION ALL ".join(
        f"""SELECT 'schema', '{c}.' || k, v, t FROM (SELECT 'dtype' AS k, CAST(NULL AS DOUBLE) AS v, '{ty}' AS t
            UNION ALL SELECT 'null_count', CAST(count(*) - count({c}) AS DOUBLE), NULL FROM lineitem
            UNION ALL SELECT 'null_percentage', (count(*) - count({c})) * 100.0 / count(*), NULL FROM lineitem
            UNION ALL SELECT 'unique_count', CAST(count(DISTINCT {c}) AS DOUBLE), NULL FROM lineitem
            UNION ALL SELECT 'unique_percentage', count(DISTINCT {c}) * 100.0 / count(*), NULL FROM lineitem
            UNION ALL SELECT 'is_numeric', {0.0 if ty in ('string', 'timestamp_ntz') else 1.0}, NULL) s{i}"""
        for i, (c, ty) in enumerate(zip(LINE_ALL, LINE_TYPES)))
    best = f"""SELECT 'correlation', 'pairs.' || k, v, t FROM (
        WITH b AS (SELECT * FROM ({_labelled(pairs)}) t WHERE correlation IS NOT NULL ORDER BY abs(correlation) DESC, column1, column2 LIMIT 1)
        SELECT 'strongest_r' AS k, correlation AS v, CAST(NULL AS VARCHAR) AS t FROM b UNION ALL SELECT 'strongest_column1', NULL, column1 FROM b
        UNION ALL SELECT 'strongest_column2', NULL, column2 FROM b UNION ALL SELECT 'strongest_strength', NULL, strength FROM b
        UNION ALL SELECT 'strongest_direction', NULL, direction FROM b) q"""
    recs = """SELECT 'recommendations', k, CAST(NULL AS DOUBLE), t FROM (VALUES
        ('1', 'Start with descriptive statistics to understand your data'), ('2', 'Check for correlations between numeric variables'),
        ('3', 'Identify and investigate outliers'), ('4', 'Analyze distributions for normality assumptions'),
        ('5', 'Use hypothesis testing to validate relationships')) r(k, t)"""
    return f"""SELECT section, item, {S('value')} AS value, text FROM (
      SELECT section, item, value, CAST(NULL AS VARCHAR) AS text FROM ({basic} UNION ALL {var} UNION ALL {out} UNION ALL {corr}) u
      UNION ALL {schema} UNION ALL {best} UNION ALL {recs}) x"""


def q_dataset_info(spark, sf):
    from ..operators.summary import dataset_info
    d = dataset_info(_t(spark, sf, "customer"), {"file_names": ["customer.parquet"]})
    lists = ("file_names", "numeric_columns", "categorical_columns", "datetime_columns", "text_columns")
    return d.withColumns({c: F.concat_ws(",", c) for c in lists} | {"columns": F.array_join(F.transform(
        "columns", lambda s: F.concat_ws(":", s["column"], s["dtype"], s["null_count"], s["unique_count"])), ",")})


def sql_dataset_info():
    kinds = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]
    cols = " || ',' || ".join(f"'{c}:{t}:' || CAST(count(*) - count({c}) AS VARCHAR) || ':' || CAST(count(DISTINCT {c}) AS VARCHAR)" for c, t in kinds)
    share = "CASE WHEN count(DISTINCT {c}) * 1.0 / count(*) {op} 0.5 THEN '{c}' END"
    texts = lambda op: "concat_ws(',', " + ", ".join(share.format(c=c, op=op) for c in ("c_name", "c_mktsegment")) + ")"
    return f"""SELECT b.total_rows, b.total_columns, b.estimated_bytes, b.missing_values, b.duplicate_rows, 'customer.parquet' AS file_names,
      CAST(NULL AS VARCHAR) AS saved_at, i.* FROM ({sql_basic_info()}) b, (SELECT {cols} AS columns,
      'c_custkey,c_nationkey,c_acctbal' AS numeric_columns, {texts('<')} AS categorical_columns, '' AS datetime_columns,
      {texts('>=')} AS text_columns FROM customer) i"""


def q_context_record(spark, sf):
    from ..operators.summary import dataset_context_record
    r = dataset_context_record(_events_with_gaps(spark, sf), ["events.parquet"])
    return sig(r.withColumns({c: F.concat_ws(",", c) for c in ("file_names", "numeric_columns", "categorical_columns")}))


def sql_context_record():
    return f"""SELECT total_rows AS rows, total_columns AS columns, 'events.parquet' AS file_names, 'event_id,user_id,value' AS numeric_columns,
      'event_type,props' AS categorical_columns, missing_values, missing_data_percentage AS missing_percentage, duplicate_rows
      FROM ({sql_quality_report()}) q"""


# ---------------------------------------------------------------- typing / cleaning
def _mixed_events(spark, sf):
    e = _t(spark, sf, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, F.lit("N/A")).when(F.col("event_id") % 7 == 0, F.lit(""))
        .otherwise(F.col("event_type")).alias("s_tok"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, F.col("value").cast("string"))
        .otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" "))).alias("s_num"),
        F.when(F.col("event_id") % 4 == 0, F.lit("N/A")).otherwise(F.col("value").cast("string")).alias("s_major"),
        F.when(F.col("event_id") % 10 < 4, F.col("user_id").cast("string")).otherwise(F.lit("x")).alias("s_minor"),
    )


MIXED_SQL = """(SELECT event_id,
  CASE WHEN event_id % 5 = 0 THEN 'N/A' WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS s_tok,
  CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN CAST(value AS VARCHAR)
       ELSE ' ' || CAST(user_id AS VARCHAR) || ' ' END AS s_num,
  CASE WHEN event_id % 4 = 0 THEN 'N/A' ELSE CAST(value AS VARCHAR) END AS s_major,
  CASE WHEN event_id % 10 < 4 THEN CAST(user_id AS VARCHAR) ELSE 'x' END AS s_minor FROM events)"""
# The missing-value tokens, written out here on their own.
_TOKENS_SQL = """'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN',
  'None', 'n/a', 'nan', 'null'"""
_NUM_RE = r"'^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])\s*$'"


def q_null_tokens(spark, sf):
    return cleaning.null_tokens(_mixed_events(spark, sf).select("event_id", "s_tok"))


def sql_null_tokens():
    return f"SELECT event_id, CASE WHEN s_tok IN ({_TOKENS_SQL}) THEN NULL ELSE s_tok END AS s_tok FROM {MIXED_SQL} m"


def q_coerce_numeric(spark, sf):
    return sig(cleaning.coerce_numeric_columns(_mixed_events(spark, sf).select("event_id", "s_num"), ["s_num"]))


def sql_coerce_numeric():
    return f"""SELECT event_id, {S(f"CASE WHEN regexp_matches(s_num, {_NUM_RE}) THEN CAST(trim(s_num) AS DOUBLE) END")} AS s_num
      FROM {MIXED_SQL} m"""


def q_infer_types(spark, sf):
    df, _ = cleaning.infer_types(cleaning.null_tokens(_mixed_events(spark, sf).select("event_id", "s_major", "s_minor", "s_tok")))
    return sig(df)


def sql_infer_types():
    return f"""SELECT event_id, {S("CAST(s_major AS DOUBLE)")} AS s_major, s_minor,
      CASE WHEN s_tok IN ({_TOKENS_SQL}) THEN NULL ELSE s_tok END AS s_tok
      FROM (SELECT event_id, CASE WHEN s_major = 'N/A' THEN NULL ELSE s_major END AS s_major, s_minor, s_tok FROM {MIXED_SQL} m) t"""


def _typed_source(spark, sf):
    """Text columns of every target: integers beyond 2**53, small integers, decimals, mostly text, categories."""
    e = _t(spark, sf, "events")
    return e.select(
        (F.col("event_id") + 9007199254740993).cast("string").alias("big"), (F.col("event_id") % 100).cast("string").alias("small"),
        F.concat((F.col("event_id") % 30000).cast("string"), F.lit(".0")).alias("whole"), F.col("value").cast("string").alias("dec"),
        F.when(F.col("event_id") % 10 < 4, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("event_id"))).alias("txt"),
        "event_type")


def q_infer_types_exact(spark, sf):
    df, _ = cleaning.infer_types(_typed_source(spark, sf), narrow=True)
    return df.select("big", F.col("small").cast("int").alias("small"), F.col("whole").cast("int").alias("whole"), "txt", "event_type")


def sql_infer_types_exact():
    return """SELECT event_id + 9007199254740993 AS big, CAST(event_id % 100 AS INTEGER) AS small, CAST(event_id % 30000 AS INTEGER) AS whole,
      CASE WHEN event_id % 10 < 4 THEN CAST(user_id AS VARCHAR) ELSE 'x' || CAST(event_id AS VARCHAR) END AS txt, event_type FROM events"""


def q_infer_types_report(spark, sf):
    return sig(cleaning.infer_types(_typed_source(spark, sf), narrow=True)[1])


def sql_infer_types_report():
    row = lambda c, x, integral, target, role, where="": f"""SELECT '{c}' AS "column", count({x}) AS parsed,
      (SELECT count(*) FROM events) AS total, {integral} AS all_integral, {S(f'CAST(min({x}) AS DOUBLE)')} AS min, {S(f'CAST(max({x}) AS DOUBLE)')} AS max,
      '{target}' AS target_type, {role} AS role FROM events{where}"""  # noqa: E731
    cat = lambda x: f"CASE WHEN count(DISTINCT {x}) * 1.0 / count(*) < 0.5 THEN 'categorical' ELSE 'text' END"
    num = "'numeric'"
    return " UNION ALL ".join([
        row("big", "event_id + 9007199254740993", "true", "bigint", num), row("small", "event_id % 100", "true", "tinyint", num),
        row("whole", "event_id % 30000", "true", "smallint", num), row("dec", "value", "count(value) = count(*) FILTER (WHERE value % 1 = 0)", "float", num),
        row("txt", "CASE WHEN event_id % 10 < 4 THEN user_id END", "true", "string",
            cat("CASE WHEN event_id % 10 < 4 THEN CAST(user_id AS VARCHAR) ELSE 'x' || CAST(event_id AS VARCHAR) END")),
        row("event_type", "CASE WHEN false THEN 1 END", "true", "string", cat("event_type"))])


def _gapped_customers(spark, sf):
    c = _t(spark, sf, "customer")
    gap = F.col("c_custkey") % 50 == 0
    return c.select(*[F.when(~gap, F.col(n)).alias(n) for n in c.columns], F.lit(None).cast("string").alias("empty_col"))


def q_drop_empty_report(spark, sf):
    r = profile.drop_empty(_gapped_customers(spark, sf))[1]
    return r.withColumn("removed_columns", F.concat_ws(",", "removed_columns"))


def sql_drop_empty_report():
    return "SELECT count(*) AS rows_removed, CAST(1 AS BIGINT) AS columns_removed, 'empty_col' AS removed_columns FROM customer WHERE c_custkey % 50 = 0"


def q_drop_empty(spark, sf):
    clean, _ = profile.drop_empty(_gapped_customers(spark, sf))
    return sig(clean)


def sql_drop_empty():
    return f"""SELECT c_custkey, c_name, c_nationkey, {S('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 <> 0"""


def q_sanitize_columns(spark, sf):
    n = _t(spark, sf, "nation").toDF("n.name", "n name", "n_name")
    return cleaning.sanitize_columns(n)


def sql_sanitize_columns():
    return "SELECT n_nationkey AS n_name, n_name AS n_name_2, n_regionkey AS n_name_3 FROM nation"


# ---------------------------------------------------------------- conversations
def q_conversation_fold(spark, sf):
    f = conversations.conversation_fold(_t(spark, sf, "conversations"))
    return f.select("conv_id", "message_count", F.md5(F.array_join(F.transform(
        "messages", lambda m: F.concat_ws("|", m["turn"].cast("string"), m["role"], m["text"])), "\n")).alias("messages_md5"))


def sql_conversation_fold():
    return """SELECT conv_id, count(*) AS message_count, md5(string_agg(concat_ws('|', CAST(turn AS VARCHAR), role, text), chr(10)
      ORDER BY turn, role, text)) AS messages_md5 FROM conversations GROUP BY conv_id"""


def q_conversation_unfold(spark, sf):
    return conversations.conversation_unfold(conversations.conversation_fold(_t(spark, sf, "conversations")))


def sql_conversation_unfold():
    return """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS position,
      turn, role, text
      FROM conversations"""


def q_conversation_segments(spark, sf):
    """Segments of four messages, unfolded again, with each message's chunk and the chunk's size."""
    g = conversations.conversation_segments(_t(spark, sf, "conversations"), size=4)
    back = conversations.segments_unfold(g).withColumn("chunk", F.expr("position div 4"))
    return back.join(g.select("conv_id", "chunk", "message_count"), ["conv_id", "chunk"])


def sql_conversation_segments():
    return """WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position,
        turn, role, text FROM conversations)
      SELECT conv_id, position // 4 AS chunk, CAST(position AS BIGINT) AS position, turn, role, text,
        count(*) OVER (PARTITION BY conv_id, position // 4) AS message_count FROM p"""


def q_conversation_counts(spark, sf):
    return conversations.conversation_counts(_t(spark, sf, "conversations"))


def sql_conversation_counts():
    return "SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role"


def q_query_topics(spark, sf):
    t = conversations.query_topics(_t(spark, sf, "conversations"))
    return t.select("conv_id", "turn", "role", F.concat_ws(",", "topics").alias("topics"))


def sql_query_topics():
    # Topics and their words, written out here on their own.
    return """WITH t AS (SELECT conv_id, turn, role, lower(text) AS x FROM conversations),
      h AS (SELECT conv_id, turn, role, concat_ws(',',
        CASE WHEN contains(x, 'mean') OR contains(x, 'average') OR contains(x, 'median') OR contains(x, 'std') OR contains(x, 'statistics')
          THEN 'descriptive_statistics' END,
        CASE WHEN contains(x, 'correlation') OR contains(x, 'relationship') THEN 'correlation_analysis' END,
        CASE WHEN contains(x, 'outlier') OR contains(x, 'anomaly') THEN 'outlier_detection' END,
        CASE WHEN contains(x, 'distribution') OR contains(x, 'normal') THEN 'distribution_analysis' END,
        CASE WHEN contains(x, 'test') OR contains(x, 'hypothesis') THEN 'hypothesis_testing' END) AS topics FROM t)
      SELECT conv_id, turn, role, CASE WHEN topics = '' THEN 'general_inquiry' ELSE topics END AS topics FROM h"""


# ---------------------------------------------------------------- sources
def q_csv_roundtrip(spark, sf):
    """Whole texts with quotes, line breaks and commas through CSV files."""
    path = scratch_dir(spark, "csv-roundtrip")
    docs = _t(spark, sf, "documents")
    quoted = F.concat(F.lit('say "'), F.col("source"), F.lit('", then: '), F.col("text"))
    csvsrc.write_csv(docs.select("doc_id", quoted.alias("text"), "lang"), path)
    back = csvsrc.read_csv(spark, path)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang",
                       F.col(csvsrc.SOURCE_FILE).rlike(r"^part-\d+-.*\.csv$").alias("from_part_file"))


def sql_csv_roundtrip():
    return """SELECT doc_id, md5('say "' || source || '", then: ' || text) AS text_md5, lang, true AS from_part_file FROM documents"""


def q_multi_file_union(spark, sf):
    """Two folders with different columns; lineage: no file holds rows of both."""
    base = scratch_dir(spark, "multi-file")
    o = _t(spark, sf, "orders")
    keep = F.col("o_orderstatus") != "P"
    csvsrc.write_csv(o.where(keep).select("o_orderkey", "o_orderstatus", "o_totalprice"), f"{base}/a")
    csvsrc.write_csv(o.where(~keep).select("o_orderkey", "o_orderstatus", "o_orderpriority"), f"{base}/b")
    u = csvsrc.read_csv(spark, [f"{base}/a", f"{base}/b"])
    open_ = F.col("o_orderstatus") == "P"
    per_file = u.groupBy(csvsrc.SOURCE_FILE).agg((F.min(open_) == F.max(open_)).alias("file_of_one_folder"))
    return sig(u.join(per_file, csvsrc.SOURCE_FILE).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "file_of_one_folder"))


def sql_multi_file_union():
    return f"""SELECT o_orderkey, o_orderstatus, {S("CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END")} AS o_totalprice,
      CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS o_orderpriority, true AS file_of_one_folder FROM orders"""


def q_dataset_roundtrip(spark, sf):
    path = scratch_dir(spark, "dataset")
    storage.save_dataset(_t(spark, sf, "part"), path, {"source": "part", "file_names": ["part.parquet"]})
    data, meta = storage.load_dataset(spark, path)
    stamp = meta.select(F.col("source").alias("meta_source"), F.concat_ws(",", "file_names").alias("meta_file_names"),
                        F.concat_ws(",", "data_shape").alias("meta_shape"), F.col("saved_at").isNotNull().alias("meta_saved"))
    return sig(profile.attach(data, stamp))


def sql_dataset_roundtrip():
    return f"""SELECT p_partkey, p_name, p_brand, p_type, p_size, {S('p_retailprice')} AS p_retailprice, 'part' AS meta_source,
      'part.parquet' AS meta_file_names, (SELECT CAST(count(*) AS VARCHAR) || ',6' FROM part) AS meta_shape, true AS meta_saved FROM part"""


ORDER_KINDS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


def q_profile_append(spark, sf):
    """Orders stored in two loads; the second is profiled by its own files and merged."""
    path, orders = scratch_dir(spark, "profiled"), _t(spark, sf, "orders")
    first = F.coalesce(F.col("o_orderdate") < "1995-01-01", F.lit(True))
    storage.save_dataset(orders.where(first), path)
    profile_state.refresh_profile(spark, path)
    profile_state.append_dataset(orders.where(~first), path)
    p = profile_state.stored_profile(spark, path)
    return sig(p.select("column", "total_rows", "null_count", "mean", "std_dev", "min", "max", "min_text", "max_text", "estimated_bytes"))


def sql_profile_append():
    parts = []
    for c, kind in ORDER_KINDS.items():
        num = kind in ("bigint", "double")
        stats = (f"{S(f'avg({c})')}, {S(f'stddev_samp({c})')}, {S(f'CAST(min({c}) AS DOUBLE)')}, {S(f'CAST(max({c}) AS DOUBLE)')}, "
                 "CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)" if num else
                 f"CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
                 f"CAST(min({c}) AS VARCHAR), CAST(max({c}) AS VARCHAR)")
        width = f"coalesce(sum(strlen({c})), 0)" if kind == "string" else f"count({c}) * {profile.FIXED_WIDTH[kind]}"
        parts.append(f"SELECT '{c}', count(*), count(*) - count({c}), {stats}, CAST({width} AS BIGINT) FROM orders")
    return ("SELECT * FROM (" + " UNION ALL ".join(parts) + ") t(\"column\", total_rows, null_count, mean, std_dev, min, max, "
            "min_text, max_text, estimated_bytes)")


def q_ingest_report(spark, sf):
    from ..operators.summary import ingest
    path = scratch_dir(spark, "ingest-src")
    csvsrc.write_csv(_t(spark, sf, "supplier"), path)
    r = ingest(spark, [path], scratch_dir(spark, "ingest-dst"))
    r = r.withColumns({c: F.concat_ws(",", c) for c in ("numeric_columns", "categorical_columns")})
    return sig(r.withColumn("file_names", F.size("file_names") > 0).withColumnRenamed("file_names", "has_file_names"))


def sql_ingest_report():
    # the fifth column is the file name, one of a few
    return """SELECT count(*) AS total_rows, CAST(5 AS BIGINT) AS total_columns, true AS has_file_names, CAST(0 AS DOUBLE) AS missing_data_percentage,
      CAST(0 AS BIGINT) AS duplicate_rows, 's_suppkey,s_nationkey,s_acctbal' AS numeric_columns,
      concat_ws(',', CASE WHEN count(DISTINCT s_name) * 1.0 / count(*) < 0.5 THEN 's_name' END, '__source_file__') AS categorical_columns
      FROM supplier"""


QUERIES = {
    "descriptive": (q_descriptive, sql_descriptive),
    "variable_summaries": (q_variable_summaries, sql_variable_summaries),
    "corr_pearson": (q_corr_pearson, sql_corr_pearson),
    "corr_wide": (q_corr_wide, sql_corr_wide),
    "corr_spearman": (q_corr_spearman, sql_corr_spearman),
    "corr_spearman_gaps": (q_corr_spearman_gaps, sql_corr_spearman_gaps),
    "corr_kendall": (q_corr_kendall, sql_corr_kendall),
    "corr_kendall_lineitem": (q_corr_kendall_lineitem, sql_corr_kendall_lineitem),
    "corr_matrix": (q_corr_matrix, sql_corr_matrix),
    "corr_top_pairs": (q_corr_top_pairs, sql_corr_top_pairs),
    "corr_summary": (q_corr_summary, sql_corr_summary),
    "outliers_iqr": (q_outliers_iqr, sql_outliers_iqr),
    "outliers_zscore": (q_outliers_zscore, sql_outliers_zscore),
    "outliers_both": (q_outliers_both, sql_outliers_both),
    "outlier_rows": (q_outlier_rows, sql_outlier_rows),
    "outlier_summary": (q_outlier_summary, sql_outlier_summary),
    "outlier_records": (q_outlier_records, sql_outlier_records),
    "outlier_records_z": (q_outlier_records_z, sql_outlier_records_z),
    "distribution_report": (q_distribution_report, sql_distribution_report),
    "distribution_shape": (q_distribution_shape, sql_distribution_shape),
    "distribution_type": (q_distribution_type, sql_distribution_type),
    "normality_shapiro": (q_normality_shapiro, sql_normality_shapiro),
    "histogram": (q_histogram, sql_histogram),
    "distribution_by_group": (q_distribution_by_group, sql_distribution_by_group),
    "value_counts": (q_value_counts, sql_value_counts),
    "categorical_profile": (q_categorical_profile, sql_categorical_profile),
    "categorical_top10": (q_categorical_top10, sql_categorical_top10),
    "categorical_summary": (q_categorical_summary, sql_categorical_summary),
    "pearson_test": (q_pearson_test, sql_pearson_test),
    "anova_test": (q_anova_test, sql_anova_test),
    "anova_groups": (q_anova_groups, sql_anova_groups),
    "chi_square_test": (q_chi_square_test, sql_chi_square_test),
    "chi_square_2x2": (q_chi_square_2x2, sql_chi_square_2x2),
    "chi_square_wide": (q_chi_square_wide, sql_chi_square_wide),
    "crosstab": (q_crosstab, sql_crosstab),
    "crosstab_wide": (q_crosstab_wide, sql_crosstab_wide),
    "anova_details": (q_anova_details, sql_anova_details),
    "chi_square_details": (q_chi_square_details, sql_chi_square_details),
    "hypothesis_auto": (q_hypothesis_auto, sql_hypothesis_auto),
    "hypothesis_auto_pearson": (q_hypothesis_auto_pearson, sql_hypothesis_auto_pearson),
    "hypothesis_auto_chi": (q_hypothesis_auto_chi, sql_hypothesis_auto_chi),
    "hypothesis_explicit": (q_hypothesis_explicit, sql_hypothesis_explicit),
    "group_aggregate": (q_group_aggregate, sql_group_aggregate),
    "compare_groups": (q_compare_groups, sql_compare_groups),
    "filter_rows": (q_filter_rows, sql_filter_rows),
    "top_k": (q_top_k, sql_top_k),
    "preview": (q_preview, sql_preview),
    "adhoc_sql": (q_adhoc_sql, sql_adhoc_sql),
    "duplicate_records": (q_duplicate_records, sql_duplicate_records),
    "duplicate_rows": (q_duplicate_rows, sql_duplicate_rows),
    "basic_info": (q_basic_info, sql_basic_info),
    "missing_cells": (q_missing_cells, sql_missing_cells),
    "estimated_bytes": (q_estimated_bytes, sql_estimated_bytes),
    "schema_overview": (q_schema_overview, sql_schema_overview),
    "column_roles": (q_column_roles, sql_column_roles),
    "column_listing": (q_column_listing, sql_column_listing),
    "column_info": (q_column_info, sql_column_info),
    "unique_values": (q_unique_values, sql_unique_values),
    "quality_report": (q_quality_report, sql_quality_report),
    "column_info_maps": (q_column_info_maps, sql_column_info_maps),
    "dataset_context": (q_dataset_context, sql_dataset_context),
    "analysis_summary": (q_analysis_summary, sql_analysis_summary),
    "dataset_info": (q_dataset_info, sql_dataset_info),
    "context_record": (q_context_record, sql_context_record),
    "null_tokens": (q_null_tokens, sql_null_tokens),
    "coerce_numeric": (q_coerce_numeric, sql_coerce_numeric),
    "infer_types": (q_infer_types, sql_infer_types),
    "infer_types_exact": (q_infer_types_exact, sql_infer_types_exact),
    "infer_types_report": (q_infer_types_report, sql_infer_types_report),
    "drop_empty": (q_drop_empty, sql_drop_empty),
    "drop_empty_report": (q_drop_empty_report, sql_drop_empty_report),
    "sanitize_columns": (q_sanitize_columns, sql_sanitize_columns),
    "conversation_fold": (q_conversation_fold, sql_conversation_fold),
    "conversation_unfold": (q_conversation_unfold, sql_conversation_unfold),
    "conversation_segments": (q_conversation_segments, sql_conversation_segments),
    "conversation_counts": (q_conversation_counts, sql_conversation_counts),
    "query_topics": (q_query_topics, sql_query_topics),
    "csv_roundtrip": (q_csv_roundtrip, sql_csv_roundtrip),
    "multi_file_union": (q_multi_file_union, sql_multi_file_union),
    "dataset_roundtrip": (q_dataset_roundtrip, sql_dataset_roundtrip),
    "profile_append": (q_profile_append, sql_profile_append),
    "ingest_report": (q_ingest_report, sql_ingest_report),
}
