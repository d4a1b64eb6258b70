"""Property checks (hypothesis): against numpy/pandas definitions on generated columns."""

import math

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quantiva.operators import categorical, correlate, describe, distribution, inference, ranks

SETTINGS = dict(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=3, max_size=40)


@settings(**SETTINGS)
@given(xs=values, parts=st.integers(1, 5))
def test_quantiles_match_numpy_and_ignore_partitioning(spark, xs, parts):
    clean = [x for x in xs if x is not None]
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(parts)
    if not clean:
        return
    r = describe.descriptive(df, ["x"]).collect()[0]
    q1, med, q3 = np.percentile(clean, [25, 50, 75])
    assert math.isclose(r["q1"], q1, abs_tol=1e-9) and math.isclose(r["median"], med, abs_tol=1e-9)
    assert math.isclose(r["q3"], q3, abs_tol=1e-9) and r["count"] == len(clean)
    vc = pd.Series(clean).value_counts()
    assert r["mode"] == min(vc[vc == vc.max()].index)


@settings(**SETTINGS)
@given(pairs=st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=4, max_size=40))
def test_spearman_bounds_symmetry_and_monotone_invariance(spark, pairs):
    df = spark.createDataFrame([(float(a), float(b), float(a) ** 3 + 1) for a, b in pairs], "a double, b double, a3 double")
    rows = {(r["column1"], r["column2"]): r["correlation"] for r in correlate.correlation(df, ["a", "b", "a3"], "spearman").collect()}
    ref = pd.DataFrame(pairs, columns=["a", "b"]).corr(method="spearman").loc["a", "b"]
    got = rows[("a", "b")]
    if ref != ref:  # undefined (a constant column)
        assert got is None
    else:
        assert math.isclose(got, ref, abs_tol=1e-9) and -1 <= got <= 1
        assert math.isclose(rows[("b", "a3")], got, abs_tol=1e-9)  # ranks of a^3 + 1 equal ranks of a


@settings(**SETTINGS)
@given(xs=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=50), bins=st.integers(1, 12))
def test_histogram_counts_sum_to_rows(spark, xs, bins):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    h = distribution.histogram(df, "x", bins).collect()
    assert len(h) == bins and sum(r["count"] for r in h) == len(xs)
    ref, _ = np.histogram(xs, bins=bins)
    assert [r["count"] for r in sorted(h, key=lambda r: r["bin"])] == list(ref)


@settings(**SETTINGS)
@given(cells=st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyzw")), min_size=5, max_size=60))
def test_chi_square_shortcut_and_entropy_bounds(spark, cells):
    df = spark.createDataFrame(cells, "p string, q string")
    ct = pd.crosstab(pd.Series([c[0] for c in cells]), pd.Series([c[1] for c in cells])).to_numpy().astype(float)
    r = inference.chi_square_test(df, "p", "q").collect()[0]
    dof = (ct.shape[0] - 1) * (ct.shape[1] - 1)
    if dof > 1:
        e = ct.sum(1, keepdims=True) * ct.sum(0, keepdims=True) / ct.sum()
        assert math.isclose(r["statistic"], ((ct - e) ** 2 / e).sum(), rel_tol=1e-9, abs_tol=1e-9)
    prof = categorical.categorical(df, ["p"]).collect()[0]
    assert -1e-12 <= prof["entropy"] <= math.log(prof["unique_values"]) + 1e-12


def test_histogram_constant_and_edge_values_match_numpy(spark):
    cases = [[0.1], [-999999.9], [123456.789, 123456.789], [0.0, 0.3, 0.6, 0.9], [1e-9, 2e-9, 3e-9]]
    for xs in cases:
        for bins in (2, 3, 7):
            df = spark.createDataFrame([(x,) for x in xs], "x double")
            got = [r["count"] for r in sorted(distribution.histogram(df, "x", bins).collect(), key=lambda r: r["bin"])]
            assert got == list(np.histogram(xs, bins=bins)[0]), (xs, bins)
