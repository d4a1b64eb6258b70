"""Mergeable profile state of stored datasets (A5, A6, A9, A10): new files cost only their own rows.

A state row holds, for one column of one batch of files, whole counts, moments
(count, mean, sum of squared deviations), ends and Spark's HyperLogLog sketch.
States merge by column; moments merge about the common mean, so there is no
difference of large sums.  ``stored_profile`` keeps states beside a dataset:

    <path>/profile/files   path, length, modificationTime, batch (files covered)
    <path>/profile/state   one row for each batch and column

A batch counts only while all its files are there unchanged; files of other
batches are profiled anew.  The state is written before the list of its files,
so a run that dies between the two leaves a state that nothing refers to.

Distinct counts are estimates: their relative standard error is about
``1.04 / sqrt(2 ** lg_k)`` (1.6 % by default).  ``profile.schema_overview``
stays exact and stays the default elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFoundError, ValidationError
from ..functions.columns import as_double, col, is_numeric_type
from ..sources import storage
from .profile import _family, _missing, _value_expr, value_bytes

LG_K = 12
STATE_SCHEMA = ("batch string, cid int, column string, dtype string, rows long, n long, mean double, m2 double, "
                "lo double, hi double, lo_text string, hi_text string, bytes long, hll binary")
_FILE = ["path", "length", "modificationTime"]


def profile_state(df: DataFrame, batch: str = "", lg_k: int = LG_K) -> DataFrame:
    """One state row for each column of ``df``, from one scan and one partially aggregated row.

    NaN counts as missing.  Numbers have mean, m2, lo and hi as doubles; text, dates and times have lo_text
    and hi_text; other types have counts, bytes and sketch only.  A table without rows gives rows of zeros.
    """
    if not 4 <= lg_k <= 21:
        raise ValidationError("lg_k must be between 4 and 21")
    if not df.columns:
        raise ValidationError("The table has no columns")
    aggs, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(df.schema.fields):
        value = _value_expr(df, f.name, _family(f.dataType))
        hashed = value.cast("long") if _family(f.dataType) == "integral" else (
            (value + F.lit(0.0)).cast("string") if _family(f.dataType) == "floating" else value)  # -0.0 is 0.0
        own = {"n": F.count_if(~_missing(df, f.name)), "bytes": value_bytes(f), "hll": F.hll_sketch_agg(hashed, F.lit(lg_k))}
        if is_numeric_type(f.dataType) and not isinstance(f.dataType, T.BooleanType):
            x = as_double(df, f.name)
            own |= {"mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "lo": F.min(x), "hi": F.max(x)}
        elif isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            own |= {"lo_text": F.min(col(f.name)).cast("string"), "hi_text": F.max(col(f.name)).cast("string")}
        aggs += [v.alias(f"{k}{i}") for k, v in own.items()]
        fixed = {"batch": F.lit(batch), "cid": F.lit(i), "column": F.lit(f.name), "dtype": F.lit(f.dataType.simpleString()),
                 "rows": F.col("rows")}
        rows.append(F.struct(*[
            (fixed[s.name] if s.name in fixed else F.col(f"{s.name}{i}") if s.name in own else F.lit(None)).cast(s.dataType).alias(s.name)
            for s in T.StructType.fromDDL(STATE_SCHEMA).fields]))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def merge_states(states: DataFrame, batch: str = "") -> DataFrame:
    """States of any number of batches as one state row for each column and type (a column whose type
    changed between batches keeps a row for each type)."""
    by = ["column", "dtype"]
    common = states.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("m"))
    apart = F.col("mean") - F.col("m")
    return states.join(common, by).groupBy(*by).agg(
        F.min("cid").alias("cid"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.first("m").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.min("lo_text").alias("lo_text"), F.max("hi_text").alias("hi_text"), F.sum("bytes").alias("bytes"),
        F.hll_union_agg("hll").alias("hll"),
    ).select(F.lit(batch).alias("batch"), "cid", "column", "dtype", "rows", "n", "mean", "m2", "lo", "hi", "lo_text", "hi_text", "bytes", "hll")


def profile_from_states(states: DataFrame) -> DataFrame:
    """column, dtype, total_rows, null_count, null_percentage, unique_estimate, unique_percentage, mean, std_dev,
    min, max, min_text, max_text, estimated_bytes; one row for each column.

    A column that some batch does not have is null there.  unique_estimate is rounded, at most the values there are.
    """
    total = states.select("batch", "rows").distinct().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("t"))
    m = merge_states(states).withColumn("total_rows", total.scalar())
    unique = F.least(F.hll_sketch_estimate("hll"), F.col("n")).cast("long")
    return m.select(
        "cid", "column", "dtype", "total_rows", (F.col("total_rows") - F.col("n")).alias("null_count"),
        (F.try_divide(F.col("total_rows") - F.col("n"), F.col("total_rows")) * 100).alias("null_percentage"),
        unique.alias("unique_estimate"), (F.try_divide(unique, F.col("total_rows")) * 100).alias("unique_percentage"),
        "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std_dev"),
        F.col("lo").alias("min"), F.col("hi").alias("max"), F.col("lo_text").alias("min_text"), F.col("hi_text").alias("max_text"),
        F.col("bytes").alias("estimated_bytes"))


def _kept(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files there are, files that intact batches cover, states of intact batches)."""
    there = storage.list_files(spark, storage.data_path(path), "*.parquet").select(*_FILE)
    if not storage._exists(spark, f"{path}/profile/files"):
        return there, there.limit(0).withColumn("batch", F.lit("")), spark.createDataFrame([], STATE_SCHEMA)
    listed = spark.read.parquet(f"{path}/profile/files")
    broken = listed.join(there, _FILE, "left_anti").select("batch").distinct()
    listed = listed.join(broken, "batch", "left_anti")
    states = spark.read.schema(STATE_SCHEMA).parquet(f"{path}/profile/state")
    return there, listed, states.join(listed.select("batch").distinct(), "batch", "left_semi").select(states.columns)


def refresh_profile(spark: SparkSession, path: str, lg_k: int = LG_K) -> int:
    """Profile the files of the dataset at ``path`` that no intact batch covers; their number.

    Only these files are read.  Their names pass through the driver, as those of any files that Spark reads.
    """
    if not storage._exists(spark, storage.data_path(path)):
        raise NotFoundError(f"No dataset stored at {path}")
    there, listed, _ = _kept(spark, path)
    new = there.join(listed, _FILE, "left_anti").collect()
    if new:
        batch = uuid.uuid4().hex
        state = profile_state(spark.read.parquet(*[r["path"] for r in new]), batch, lg_k)
        state.write.mode("append").parquet(f"{path}/profile/state")
        files = spark.createDataFrame(new, there.schema).withColumn("batch", F.lit(batch))
        files.coalesce(1).write.mode("append").parquet(f"{path}/profile/files")
    return len(new)


def stored_profile(spark: SparkSession, path: str, lg_k: int = LG_K) -> DataFrame:
    """The profile of all rows of the dataset at ``path``, after reading only files that have no state yet."""
    refresh_profile(spark, path, lg_k)
    return profile_from_states(_kept(spark, path)[2])


def append_dataset(df: DataFrame, path: str) -> DataFrame:
    """Add rows to a saved dataset and bring its metadata up to date (data_shape, saved_at; the rest stays);
    the new metadata row.  Rows are counted from the states, so only new files are read."""
    spark = df.sparkSession
    _, metadata = storage.load_dataset(spark, path)
    old = metadata.collect()  # one row
    df.write.mode("append").parquet(storage.data_path(path))
    profile = stored_profile(spark, path)
    shape = profile.agg(F.array(F.max("total_rows"), F.count(F.lit(1)).cast("long")).alias("data_shape")).collect()[0]["data_shape"]
    row = spark.createDataFrame(old, metadata.schema).drop("saved_at").withColumn(
        "data_shape", F.array(*[F.lit(x).cast("long") for x in shape]))
    storage.save_metadata(row, path)
    return spark.read.json(storage.metadata_path(path))
