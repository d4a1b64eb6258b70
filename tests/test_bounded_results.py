"""Result rows and wide tables with stated bounds; samples that do not depend on partitions."""

import tempfile

import pytest
from pyspark.sql import functions as F

from quantiva.errors import AnalysisError
from quantiva.operators import inference, normality


def test_details_of_each_test(spark, employees, monkeypatch):
    row = inference.hypothesis_test(employees, "salary", "department", details=True).collect()[0]
    assert (row["groups"], [tuple(g) for g in row["group_sizes"]], row["contingency"]) == (
        3, [("Engineering", 5), ("Marketing", 3), ("Sales", 2)], None)
    two = employees.withColumn("senior", (F.col("age") > 33).cast("string"))
    row = inference.hypothesis_test(two, "department", "senior", details=True).collect()[0]
    assert row["groups"] is None and row["group_sizes"] is None and sum(c["n"] for c in row["contingency"]) == 10
    assert [tuple(c) for c in row["contingency"]][:2] == [("Engineering", "false", 3), ("Engineering", "true", 2)]
    row = inference.hypothesis_test(employees, "age", "salary", details=True).collect()[0]
    assert row["groups"] is None and row["contingency"] is None and row["test_type"] == inference.PEARSON
    assert inference.hypothesis_test(employees, "age", "salary").columns == inference.RESULT_COLUMNS
    monkeypatch.setattr(inference, "MAX_CELLS", 2)
    with pytest.raises(AnalysisError, match="More than 2 groups"):
        inference.hypothesis_test(employees, "salary", "department", details=True)
    assert inference.hypothesis_test(employees, "salary", "department").count() == 1


def test_wide_crosstab_is_bounded(spark):
    df = spark.range(20_000).select((F.col("id") % 3).cast("string").alias("a"), F.col("id").cast("string").alias("b"))
    with pytest.raises(AnalysisError, match="more than 1000 values"):
        inference.crosstab_wide(df, "a", "b")
    assert inference.crosstab(df, "a", "b").count() == 20_000
    out = inference.crosstab_wide(df, "b", "a")
    assert out.columns == ["a", "0", "1", "2"] and out.count() == 20_000


def test_default_sample_does_not_depend_on_partitions(spark):
    path = tempfile.mkdtemp(prefix="qv-norm-") + "/t"
    spark.range(9_000).select(F.randn(3).alias("x")).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    one = normality.normality(df, ["x"], max_n=500).collect()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        two = normality.normality(spark.read.parquet(path).where("x is not null"), ["x"], max_n=500).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert one == two and one[0]["sample_size_used"] == 500
    assert normality.row_place(df) and normality.row_place(spark.range(3)) is None
    assert normality.normality(spark.range(50).select(F.randn(1).alias("x")), ["x"]).collect()[0]["n"] == 50
