"""FX3-FX6 and plan-shape checks."""

import pytest
from pyspark.sql import functions as F

from quantiva.functions.pvalues import chi2_sf
from quantiva.operators import cleaning, conversations, inference, normality, ranks
from quantiva.operators.describe import descriptive
from quantiva.plans.inspect import assert_no_cartesian


def test_numeric_text_and_tokens(spark):
    texts = ["1", " 2 ", "1e3", "inf", "", "NA", "N/A", "null", "NaN", "0x1A", "True", "1,000", "1d", "abc"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r["s"] for r in cleaning.coerce_numeric_columns(cleaning.null_tokens(df), ["s"]).collect()]
    assert got[:4] == [1.0, 2.0, 1000.0, float("inf")]
    assert all(v is None for v in got[4:])


def test_infer_types_majority(spark):
    six = spark.createDataFrame([(str(i),) for i in range(6)] + [("x",)] * 4, "s string")
    out, rep = cleaning.infer_types(six)
    assert dict(out.dtypes)["s"] == "bigint" and out.where("s IS NULL").count() == 4
    five = spark.createDataFrame([(str(i),) for i in range(5)] + [("x",)] * 5, "s string")
    out5, _ = cleaning.infer_types(five)
    assert dict(out5.dtypes)["s"] == "string"
    narrow, _ = cleaning.infer_types(spark.createDataFrame([("1",), ("100",)], "s string"), narrow=True)
    assert dict(narrow.dtypes)["s"] == "tinyint"


def test_sanitize(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `a b` int, a_b int")
    assert cleaning.sanitize_columns(df).columns == ["a_b", "a_b_2", "a_b_3"]


def _table(spark, cells):
    rows = []
    for i, row in enumerate(cells):
        for j, n in enumerate(row):
            rows += [(f"r{i}", f"c{j}")] * n
    return spark.createDataFrame(rows, "a string, b string")


def test_chi_square_yates_and_wide(spark):
    r = inference.chi_square_test(_table(spark, [[10, 5], [4, 11]]), "a", "b").collect()[0]
    assert abs(r["statistic"] - 3.348214) < 1e-5 and r["df1"] == 1 and abs(r["p_value"] - 0.067278) < 1e-5
    w = inference.chi_square_test(_table(spark, [[10, 20, 30], [20, 20, 20]]), "a", "b").collect()[0]
    assert abs(w["statistic"] - 5.333333) < 1e-5 and w["df1"] == 2 and abs(w["p_value"] - 0.069483) < 1e-5
    one = inference.chi_square_test(_table(spark, [[3, 4, 5]]), "a", "b").collect()[0]
    assert one["statistic"] == 0 and one["p_value"] == 1
    assert abs(chi2_sf(4.821429, 1) - 0.028108) < 1e-5


def test_shapiro_examples():
    w, p = normality.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert abs(w - 0.788815) < 1e-5 and abs(p - 0.006704) < 1e-5
    w, p = normality.shapiro_wilk([0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93,
                                   0.42, 4.97, 9.53, 4.55, 0.47, 6.66])
    assert abs(w - 0.900473) < 1e-5 and abs(p - 0.042090) < 1e-5


def test_normality_sample_is_bounded_and_seeded(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    a = normality.normality(df, ["l_quantity"], max_n=500, seed=1).collect()[0]
    b = normality.normality(df, ["l_quantity"], max_n=500, seed=1).collect()[0]
    assert a["sample_size_used"] == 500 and a["statistic"] == b["statistic"]


def test_topics(spark):
    df = spark.createDataFrame([("What is the mean and std?",), ("latest news",), ("hello",)], "text string")
    got = [r["topics"] for r in conversations.query_topics(df).collect()]
    assert got == [["descriptive_statistics"], ["hypothesis_testing"], ["general_inquiry"]]


def test_conversation_fold_roundtrip(spark):
    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    back = conversations.conversation_unfold(conversations.conversation_fold(c)).select("conv_id", "turn", "role", "text")
    assert back.exceptAll(c.select("conv_id", "turn", "role", "text")).count() == 0
    assert back.count() == c.count()


def test_exact_quantiles_match_percentile(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    q = ranks.exact_quantiles(df, [F.col("l_extendedprice")], {"a": 0.1, "b": 0.5, "c": 0.93}).collect()[0]
    ref = df.select(F.percentile("l_extendedprice", [0.1, 0.5, 0.93])).collect()[0][0]
    assert [round(q["a"], 6), round(q["b"], 6), round(q["c"], 6)] == [round(x, 6) for x in ref]


def test_plans_have_no_cartesian(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert_no_cartesian(descriptive(df, ["l_quantity", "l_tax"]))
    assert_no_cartesian(inference.anova_test(df, "l_quantity", "l_returnflag"))


def test_entry_contract(spark):
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    out = E.entry(spark)
    assert out.count() == 4 and "median" in out.columns


def test_wide_forms(spark):
    from quantiva.operators import categorical
    df = _table(spark, [[10, 5], [4, 11]])
    wide = {r["a"]: (r["c0"], r["c1"]) for r in inference.crosstab_wide(df, "a", "b").collect()}
    assert wide == {"r0": (10, 5), "r1": (4, 11)}
    m = categorical.categorical_distribution_map(df, ["a", "b"], 1).collect()
    assert {r["column"]: dict(r["distribution"]) for r in m} == {"a": {"r0": 15}, "b": {"c1": 16}}


def test_no_window_over_a_whole_table(spark):
    from pyspark.sql import Window
    from quantiva.plans.inspect import assert_no_global_window
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert_no_global_window(descriptive(df, ["l_quantity", "l_extendedprice"]))
    with pytest.raises(AssertionError):
        assert_no_global_window(df.select(F.row_number().over(Window.orderBy("l_quantity")).alias("r")))
