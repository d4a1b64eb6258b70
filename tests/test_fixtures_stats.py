"""FX1/FX2 hand-computed values (FIXTURES.md)."""

import math

import pytest
from pyspark.sql import functions as F

from quantiva.operators import categorical, correlate, describe, inference, outliers, profile
from quantiva.operators.kendall import weighted_discordant


def approx(a, b, tol=1e-5):
    return a is not None and abs(a - b) <= tol * max(1.0, abs(b))


def test_descriptive_employees(employees):
    rows = {r["column"]: r for r in describe.descriptive(employees).collect()}
    s = rows["salary"]
    assert s["count"] == 10 and approx(s["mean"], 59400.0) and approx(s["median"], 59000.0)
    assert s["mode"] == 52000 and approx(s["std_dev"], 5541.760651) and approx(s["variance"], 30711111.111111)
    assert approx(s["q1"], 55250) and approx(s["q3"], 62500)
    assert approx(s["skewness"], 0.500764) and approx(s["kurtosis"], -0.625022) and approx(s["coef_var"], 9.329563)
    a = rows["age"]
    assert approx(a["median"], 33.5) and approx(a["q1"], 29.5) and approx(a["q3"], 37.5) and a["mode"] == 25
    y = rows["years_experience"]
    assert y["mode"] == 3 and approx(y["q3"], 9.5) and approx(y["kurtosis"], -0.892795)


def test_correlations_employees(employees):
    cols = ["age", "salary", "years_experience"]
    exp = {
        "pearson": {("age", "salary"): 0.250443, ("age", "years_experience"): 0.574913, ("salary", "years_experience"): 0.164813},
        "spearman": {("age", "salary"): 0.260606, ("age", "years_experience"): 0.682940, ("salary", "years_experience"): 0.128051},
        "kendall": {("age", "salary"): 0.2, ("age", "years_experience"): 0.659261, ("salary", "years_experience"): 0.068199},
    }
    for method, pairs in exp.items():
        got = {(r["column1"], r["column2"]): r["correlation"] for r in correlate.correlation(employees, cols, method).collect()}
        for k, v in pairs.items():
            assert approx(got[k], v), (method, k, got[k], v)


def test_pearson_test_and_anova(employees):
    p = inference.pearson_test(employees, "age", "salary").collect()[0]
    assert approx(p["p_value"], 0.485244) and p["df1"] == 8
    a = inference.anova_test(employees, "salary", "department").collect()[0]
    assert approx(a["statistic"], 0.805935) and a["df1"] == 2 and a["df2"] == 7
    groups = {r["group"]: r["mean"] for r in inference.anova_groups(employees, "salary", "department").collect()}
    assert approx(groups["Engineering"], 61000) and approx(groups["Marketing"], 59666.666667) and approx(groups["Sales"], 55000)
    auto = inference.hypothesis_test(employees, "department", "salary").collect()[0]
    assert auto["test_type"] == "One-way ANOVA" and auto["variables"] == ["salary", "department"]


def test_entropy_and_iqr(employees):
    c = {r["column"]: r for r in categorical.categorical(employees, ["department"]).collect()}
    assert approx(c["department"]["entropy"], 1.029653) and c["department"]["top_value"] == "Engineering"
    o = {(r["column"], r["method"]): r for r in outliers.outliers(employees, ["salary"]).collect()}
    assert approx(o[("salary", "iqr")]["lower_bound"], 44375) and approx(o[("salary", "iqr")]["upper_bound"], 73375)
    assert o[("salary", "iqr")]["count"] == 0


def test_basic_info_employees(employees):
    b = profile.basic_info(employees).collect()[0]
    assert b["total_rows"] == 10 and b["total_columns"] == 5 and b["numeric_columns"] == 3
    assert b["missing_values"] == 0 and b["duplicate_rows"] == 0


def test_edge_constant_one_row_nan(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "k double, a double")
    d = {r["column"]: r for r in describe.descriptive(df).collect()}
    assert d["k"]["std_dev"] == 0 and d["k"]["skewness"] is None and d["k"]["mode"] == 5
    r = correlate.correlation(df, ["a", "k"]).collect()[0]
    assert r["correlation"] is None  # must not throw under ANSI
    z = {(x["column"], x["method"]): x["count"] for x in outliers.outliers(df, ["k"]).collect()}
    assert z[("k", "zscore")] == 0
    one = describe.descriptive(spark.createDataFrame([(3.0,)], "x double")).collect()[0]
    assert one["std_dev"] is None and one["mean"] == one["median"] == one["mode"] == 3
    nan = describe.descriptive(spark.createDataFrame([(float("nan"),), (1.0,)], "x double")).collect()[0]
    assert nan["count"] == 1 and nan["mean"] == 1


def test_edge_mode_tie_mean_zero_skewed(spark):
    m = describe.descriptive(spark.createDataFrame([(v,) for v in [3, 1, 3, 1, 2]], "x bigint")).collect()[0]
    assert m["mode"] == 1
    z = describe.descriptive(spark.createDataFrame([(-1.0,), (1.0,)], "x double")).collect()[0]
    assert z["coef_var"] is None
    s = describe.descriptive(spark.createDataFrame([(float(v),) for v in [1, 2, 2, 4, 9]], "x double")).collect()[0]
    assert approx(s["skewness"], 1.114096) and approx(s["kurtosis"], -0.322038)
    assert (s["q1"], s["median"], s["q3"]) == (2.0, 2.0, 4.0)


def test_pairwise_spearman_and_zero_direction(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, None), (4.0, 5.0), (100.0, 4.0)], "x double, y double")
    r = correlate.correlation(df, ["x", "y"], "spearman").collect()[0]
    assert approx(r["correlation"], 0.6) and r["n"] == 4
    zero = spark.createDataFrame([(1.0, 1.0), (2.0, 0.0), (3.0, 1.0)], "x double, y double")
    assert correlate.correlation(zero, ["x", "y"]).collect()[0]["direction"] == "negative"


def test_duplicates_with_nulls_and_iqr_boundary(spark):
    d = spark.createDataFrame([(None,), (None,), (1,)], "x int")
    assert profile.duplicate_rows(d).collect()[0]["duplicate_rows"] == 1
    # value exactly on a fence is not an outlier: 1..4 and 8.5 -> q1=2, q3=4, hi=7 ... use exact fence value
    b = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 7]], "x double")  # q1 2, q3 4, hi 7
    o = {x["method"]: x for x in outliers.outliers(b, ["x"], ["iqr"]).collect()}
    assert o["iqr"]["upper_bound"] == 7.0 and o["iqr"]["count"] == 0


def test_kendall_kernel_matches_brute_force():
    import numpy as np
    rng = np.random.default_rng(7)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        x = rng.integers(0, 5, n).astype(float)
        y = rng.integers(0, 5, n).astype(float)
        w = rng.integers(1, 5, n)
        brute = sum(int(w[i]) * int(w[j]) for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
        assert weighted_discordant(x, y, w) == brute


def test_kendall_split_groups_equal_one_group(spark, monkeypatch):
    import quantiva.operators.kendall as K
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    pairs = [("c_nationkey", "c_acctbal"), ("c_custkey", "c_nationkey")]
    one = {(r["column1"], r["column2"]): (r["discordant"], r["tau_b"]) for r in K.kendall_pairs(df, pairs).collect()}
    monkeypatch.setattr(K, "TARGET_POINTS", 7)
    many = {(r["column1"], r["column2"]): (r["discordant"], r["tau_b"]) for r in K.kendall_pairs(df, pairs).collect()}
    assert one == many


def test_explicit_test_types_and_errors(employees):
    from quantiva.errors import ValidationError
    c = inference.hypothesis_test(employees, "age", "salary", "correlation").collect()[0]
    assert c["test_type"] == "Pearson Correlation" and c["statistic"] is not None
    x = inference.hypothesis_test(employees, "department", "name", "chi_square").collect()[0]
    assert x["test_type"] == "Chi-square Test of Independence"
    with pytest.raises(ValidationError):
        inference.hypothesis_test(employees, "age", "salary", "t_test")


def test_distribution_report_sentence(spark):
    from quantiva.operators.distribution import distribution_report
    df = spark.createDataFrame([(float(v),) for v in [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]], "x double")
    r = distribution_report(df, ["x"]).collect()[0]
    assert r["interpretation"].startswith("Distribution analysis for 'x': Non-normal distribution (Shapiro-Wilk p-value: 0.0067).")


def test_descriptive_approx_quartiles_close_to_exact(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    exact = {r["column"]: r for r in describe.descriptive(df, ["l_quantity", "l_extendedprice"]).collect()}
    appr = {r["column"]: r for r in describe.descriptive(df, ["l_quantity", "l_extendedprice"], approx=True).collect()}
    assert abs(appr["l_quantity"]["median"] - exact["l_quantity"]["median"]) <= 1.0
    span = exact["l_extendedprice"]["range"]
    for k in ("q1", "median", "q3"):
        assert abs(appr["l_extendedprice"][k] - exact["l_extendedprice"][k]) <= 0.01 * span
    assert appr["l_quantity"]["mode"] == exact["l_quantity"]["mode"]
