"""Mergeable profile state: appended, removed and changed files; first distinct values of a task."""

import tempfile

import pytest
from pyspark.sql import functions as F

from quantiva.errors import NotFoundError, ValidationError
from quantiva.operators import profile, profile_state
from quantiva.sources import storage


def _table(spark, lo, hi):
    i = F.col("id")
    return spark.range(lo, hi, 1, 3).select(
        i, F.when(i % 7 != 0, F.lit(1e9) + F.sin(i)).alias("x"), F.when(i % 5 == 0, float("nan")).otherwise(i % 3 * -0.0).alias("z"),
        F.concat(F.lit("k"), i % 400).alias("key"), F.date_add(F.lit("2020-01-01").cast("date"), (i % 900).cast("int")).alias("d"),
        F.lit(None).cast("string").alias("none"), F.array(i % 4).alias("list"), (i % 2 == 0).alias("flag"))


def _same(got, df, lg_k=profile_state.LG_K):
    rows = {r["column"]: r for r in got.collect()}
    whole = {r["column"]: r for r in profile.schema_overview(df).collect()}
    assert set(rows) == set(df.columns)
    x = df.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()[0]
    assert (rows["x"]["min"], rows["x"]["max"]) == (x["lo"], x["hi"])
    assert rows["x"]["mean"] == pytest.approx(x["m"], rel=1e-12) and rows["x"]["std_dev"] == pytest.approx(x["s"], rel=1e-6)
    error = 4 * 1.04 / 2 ** (lg_k / 2)
    for c, r in rows.items():
        assert (r["null_count"], r["total_rows"], r["dtype"]) == (whole[c]["null_count"], df.count(), whole[c]["dtype"])
        assert abs(r["unique_estimate"] - whole[c]["unique_count"]) <= error * whole[c]["unique_count"]
    assert sum(r["estimated_bytes"] for r in rows.values()) == profile.estimated_bytes(df).collect()[0]["estimated_bytes"]
    return rows


def test_profile_after_appends_equals_a_whole_one(spark):
    path = tempfile.mkdtemp(prefix="qv-prof-") + "/ds"
    with pytest.raises(NotFoundError):
        profile_state.refresh_profile(spark, path)
    storage.save_dataset(_table(spark, 0, 3_000), path, {"source": "t"})
    assert profile_state.refresh_profile(spark, path) == 3
    assert profile_state.refresh_profile(spark, path) == 0
    meta = profile_state.append_dataset(_table(spark, 3_000, 9_000), path).collect()[0]
    assert (list(meta["data_shape"]), meta["source"]) == ([9_000, 8], "t")
    rows = _same(profile_state.stored_profile(spark, path), _table(spark, 0, 9_000))
    assert (rows["d"]["min_text"], rows["d"]["max_text"]) == ("2020-01-01", "2022-06-18")
    assert rows["none"]["unique_estimate"] == 0 and rows["none"]["max_text"] is None and rows["z"]["unique_estimate"] == 1
    assert spark.read.parquet(f"{path}/profile/state").select("batch").distinct().count() == 2
    # a dataset written anew: no batch is intact any more, so all of it is read again
    storage.save_data(_table(spark, 50, 1_000), path)
    _same(profile_state.stored_profile(spark, path), _table(spark, 50, 1_000))


def test_state_without_a_list_of_files_counts_for_nothing(spark):
    path = tempfile.mkdtemp(prefix="qv-prof-") + "/ds"
    storage.save_dataset(_table(spark, 0, 100), path)
    profile_state.profile_state(_table(spark, 0, 100), "died").write.parquet(f"{path}/profile/state")
    _same(profile_state.stored_profile(spark, path), _table(spark, 0, 100))


def test_states_merge_in_any_grouping(spark):
    parts = [profile_state.profile_state(_table(spark, a, b), str(a), 10) for a, b in ((0, 10), (10, 10), (10, 5_000))]
    left = profile_state.merge_states(parts[0].union(parts[1]), "l").union(parts[2])
    _same(profile_state.profile_from_states(left), _table(spark, 0, 5_000), 10)
    empty = {r["column"]: r for r in profile_state.profile_from_states(parts[1]).collect()}
    assert (empty["x"]["total_rows"], empty["x"]["mean"], empty["x"]["null_percentage"], empty["x"]["unique_estimate"]) == (0, None, None, 0)
    more = parts[0].union(profile_state.profile_state(spark.range(4).select("id", F.lit(1).alias("new")), "b", 10))
    got = {r["column"]: (r["total_rows"], r["null_count"]) for r in profile_state.profile_from_states(more).collect()}
    assert got["new"] == (14, 10) and got["key"] == (14, 4) and got["id"] == (14, 0)
    with pytest.raises(ValidationError):
        profile_state.profile_state(spark.range(3), lg_k=30)


def test_first_distinct_values_are_cut_in_each_task(spark):
    df = spark.range(0, 50_000, 1, 4).select(
        (F.col("id") * 7919 % 50_000).alias("v"), F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("zero"),
        F.when(F.col("id") % 9 == 0, float("nan")).otherwise(F.col("id") % 40 / 4.0).alias("f"),
        F.concat(F.lit("\u00e9"), F.col("id") % 3_000).alias("s"), (F.col("id") % 3).cast("decimal(9,2)").alias("p"),
        F.array(F.col("id") % 3).alias("a"), F.lit(None).cast("int").alias("none"))
    assert profile._least_values(df.select(F.col("v").alias("value")), 10).count() == 4 * 11
    for c in df.columns:
        for limit in (1, 10):
            want = df.select(F.col(c).alias("value")).where("value is not null").distinct().orderBy("value").limit(limit).collect()
            assert str(profile.unique_values(df, c, limit).collect()) in (str(want), str(want).replace("0.0", "-0.0"))
