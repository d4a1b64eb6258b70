"""Typed errors (argument checks that replace the service's request validators)."""

import pytest

from quantiva.errors import AnalysisError, ValidationError
from quantiva.functions import pvalues
from quantiva.operators import adhoc, cleaning, correlate, describe, distribution, inference, outliers, profile
from quantiva.operators.roles import numeric_columns


def test_validation_errors(employees):
    with pytest.raises(ValidationError):
        describe.descriptive(employees, ["nope"])
    with pytest.raises(ValidationError):
        describe.descriptive(employees, ["department"])  # not numeric
    with pytest.raises(ValidationError):
        profile.unique_values(employees, "department", 0)
    with pytest.raises(ValidationError):
        profile.unique_values(employees, "department", 1001)
    with pytest.raises(ValidationError):
        outliers.outliers(employees, ["salary"], ["mad"])
    with pytest.raises(ValidationError):
        correlate.correlation(employees, ["age", "salary"], "distance")
    with pytest.raises(ValidationError):
        distribution.histogram(employees, "salary", 0)
    with pytest.raises(ValidationError):
        adhoc.group_aggregate(employees, "department", {"salary": ["median_of_medians"]})
    with pytest.raises(ValidationError):
        adhoc.top_k(employees, "salary", 0)


def test_analysis_errors(employees):
    with pytest.raises(AnalysisError):
        correlate.correlation(employees, ["age"])


def test_unique_values_and_top_k(employees):
    assert [r["value"] for r in profile.unique_values(employees, "department", 2).collect()] == ["Engineering", "Marketing"]
    top = adhoc.top_k(employees, "salary", 3, ["name"]).collect()
    assert [r["salary"] for r in top] == [70000, 65000, 63000]
    g = {r["department"]: r for r in adhoc.compare_groups(employees, "department", "salary").collect()}
    assert abs(g["Sales"]["diff_from_overall"] - (55000 - 59400)) < 1e-9 and g["Sales"]["n"] == 2


def test_too_little_data_raises(spark):
    two = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 1.0, "a")], "x double, y double, g string")
    with pytest.raises(AnalysisError):
        inference.pearson_test(two, "x", "y")
    with pytest.raises(AnalysisError):
        inference.anova_test(two, "x", "g")


def test_chi_square_of_cells_beyond_four_billion_rows(spark):
    cells = [("a", "x", 5 * 10**9), ("a", "y", 4 * 10**9), ("b", "x", 6 * 10**9), ("b", "y", 5 * 10**9), ("c", "x", 10**9)]
    r = inference.chi_square_of(spark.createDataFrame(cells, "a string, b string, n long"), "p", "q").collect()[0]
    rows, cols, n = {}, {}, 0
    for a, b, k in cells:
        rows[a], cols[b], n = rows.get(a, 0) + k, cols.get(b, 0) + k, n + k
    o = {(a, b): k for a, b, k in cells}
    want = sum((o.get((a, b), 0) - rows[a] * cols[b] / n) ** 2 / (rows[a] * cols[b] / n) for a in rows for b in cols)
    assert r["statistic"] == pytest.approx(want, rel=1e-9) and r["n"] == n and r["p_value"] == 0.0


@pytest.mark.parametrize("got, want", [
    (lambda: pvalues.chi2_sf(1e9, 1e9), 0.4999940), (lambda: pvalues.t_sf2(2.0, 1e12), 0.0455002639), (lambda: pvalues.t_sf2(2.0, 1e13), 0.0455002639),
    (lambda: pvalues.f_sf(3.0, 2, 1e13), 0.0497870684), (lambda: pvalues.t_sf2(2.0, 1e6), 0.0455005341), (lambda: pvalues.chi2_sf(210000.0, 200000.0), None),
    (lambda: pvalues.chi2_sf(3.0, 2), 0.2231301601), (lambda: pvalues.f_sf(2.5, 3, 40), 0.0732543520)])
def test_p_values_at_any_degrees_of_freedom(got, want):
    p = got()
    if want is None:  # against the series just below the switch to the uniform expansion
        assert 0 < p < 1e-40
    else:
        assert p == pytest.approx(want, rel=2e-6)


def test_uniform_expansion_joins_the_series():
    a = pvalues.LARGE
    for z in (-3, -0.5, 0.0, 0.3, 2, 5):
        x = a + z * a ** 0.5
        assert pvalues._uniform_gammaincc(a, x) == pytest.approx(pvalues.gammaincc(a, x), rel=1e-8)


def test_sanitize_names_never_clash(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a b", "a_b", "a_b_2", "a-b"])
    assert cleaning.sanitize_columns(df).columns == ["a_b", "a_b_2", "a_b_2_2", "a_b_3"]


def test_integers_keep_all_their_digits(spark):
    rows = [("9007199254740993", "1e20", "7.0"), ("-9223372036854775808", "3", "1e3"), (" 9007199254740995 ", "99999999999999999999", "-2")]
    out, report = cleaning.infer_types(spark.createDataFrame(rows, "a string, b string, c string"))
    assert dict(out.dtypes) == {"a": "bigint", "b": "double", "c": "bigint"}
    assert [r["a"] for r in out.collect()] == [9007199254740993, -9223372036854775808, 9007199254740995]
    assert [r["c"] for r in out.collect()] == [7, 1000, -2]
    narrow, _ = cleaning.infer_types(spark.createDataFrame(rows, "a string, b string, c string"), narrow=True)
    assert dict(narrow.dtypes)["c"] == "smallint"


def test_roles_follow_an_overwritten_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("1",), ("2",)], "x string").write.parquet(path)
    assert numeric_columns(spark.read.parquet(path)) == ["x"]
    spark.createDataFrame([("one",)], "x string").write.mode("overwrite").parquet(path)
    assert numeric_columns(spark.read.parquet(path)) == []


def test_distinct_decimals_are_exact(spark):
    df = spark.sql("select cast('0.12345678901234567890123456789012345678' as decimal(38,38)) x union all "
                   "select cast('0.12345678901234567890123456789012345679' as decimal(38,38))")
    assert profile.schema_overview(df).collect()[0]["unique_count"] == 2


def test_duplicate_count_shuffles_hashes_only(spark):
    rows = [(1, None, 0.0), (1, None, -0.0), (None, 1, 0.0), (2, 3, 1.5), (2, 3, 1.5), (2, 3, 1.5)]
    df = spark.createDataFrame(rows, "a int, b int, c double")
    out = profile.duplicate_rows(df)
    assert out.collect()[0]["duplicate_rows"] == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(__h1" in plan
