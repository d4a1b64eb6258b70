"""Categorical profile (G1-G7): value counts and their per-column summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.columns import check_columns, col, long_text, name_at
from ..session import ensure_checkpoint_dir
from .roles import categorical_columns


def resolve_categorical(df: DataFrame, columns) -> list[str]:
    if columns is None:
        names = categorical_columns(df)
    else:
        names = check_columns(df, [columns] if isinstance(columns, str) else columns)
    if not names:
        raise ValidationError("No categorical columns")
    return names


def _vc(df: DataFrame, names: list[str]) -> DataFrame:
    """(cid, value, count) over non-null values; partial aggregation before the shuffle."""
    return long_text(df, names).groupBy("cid", "value").agg(F.count(F.lit(1)).alias("count"))


def global_rank(vc: DataFrame) -> DataFrame:
    """Rank (1-based) of every (cid, value) by count desc, value asc -- without
    putting a whole column in one task.

    A range-partitioned global sort spreads the rows (the sort key includes
    the value, so many equal counts still split); a reliable checkpoint fixes
    partition ids and row ids (and cuts lineage); per-partition segment sizes
    (one row per partition and column) give each segment's starting rank.
    """
    spark = vc.sparkSession
    ensure_checkpoint_dir(spark)
    s = vc.orderBy("cid", F.col("count").desc(), F.col("value").asc())
    s = s.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")).checkpoint(eager=True)
    seg = s.groupBy("_p", "cid").agg(F.count(F.lit(1)).alias("_c"), F.min("_i").alias("_i0"))
    w = Window.partitionBy("cid").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select("_p", "cid", "_i0", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    # seg: one row per (partition, column) segment -- bounded by partitions + columns
    return s.join(seg, ["_p", "cid"]).select(
        "cid", "value", "count", (F.col("_off") + F.col("_i") - F.col("_i0") + 1).alias("rank"))


def value_counts(df: DataFrame, columns=None, top: int | None = None) -> DataFrame:
    """G1: column, value, count, rank (count desc, then value asc); ``top`` keeps ranks <= top.

    With ``top`` the per-column ``row_number() <= top`` is planned as a
    window-group limit (each task keeps ``top`` rows per column before the
    shuffle).  Without it every value is ranked by ``global_rank``.
    """
    names = resolve_categorical(df, columns)
    vc = _vc(df, names)
    if top is not None:
        w = Window.partitionBy("cid").orderBy(F.col("count").desc(), F.col("value").asc())
        out = vc.select("cid", "value", "count", F.row_number().over(w).alias("rank")).where(F.col("rank") <= int(top))
    else:
        out = global_rank(vc)
    return out.select(name_at(names, F.col("cid")).alias("column"), "value",
                      F.col("count").cast("long").alias("count"), F.col("rank").cast("long").alias("rank"))


def categorical(df: DataFrame, columns=None) -> DataFrame:
    """Column, unique_values, top_value, top_count, top_percentage,
    entropy (natural log), missing_values."""
    names = resolve_categorical(df, columns)
    vc = _vc(df, names)
    cnt = F.col("count")
    per = vc.groupBy("cid").agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.sum(cnt).alias("non_null"),
        F.min_by(F.struct(cnt.alias("c"), F.col("value").alias("v")), F.struct(-cnt, F.col("value"))).alias("top"),
        F.sum(cnt * F.ln(cnt)).alias("_clnc"),
    )
    missing = df.agg(*[(F.count(F.lit(1)) - F.count(col(n))).alias(f"m{i}") for i, n in enumerate(names)])
    miss_long = missing.select(F.explode(F.array(*[F.struct(F.lit(i).alias("cid"), F.col(f"m{i}").alias("missing_values"))
                                                  for i in range(len(names))])).alias("r")).select("r.*")
    # entropy = -sum p ln p = ln N - sum c ln c / N
    res = miss_long.join(per, "cid", "left")
    return res.select(
        name_at(names, F.col("cid")).alias("column"),
        F.coalesce(F.col("unique_values"), F.lit(0)).cast("long").alias("unique_values"),
        F.col("top.v").alias("top_value"),
        F.col("top.c").cast("long").alias("top_count"),
        (F.try_divide(F.col("top.c"), F.col("non_null")) * 100).alias("top_percentage"),
        (F.ln(F.col("non_null")) - F.try_divide(F.col("_clnc"), F.col("non_null"))).alias("entropy"),
        F.col("missing_values").cast("long").alias("missing_values"),
    )


def categorical_top(df: DataFrame, columns=None, k: int = 10) -> DataFrame:
    """The top ``k`` values per column in long form (column, value, count, rank)."""
    return value_counts(df, columns, top=k)


def categorical_distribution_map(df: DataFrame, columns=None, k: int = 10) -> DataFrame:
    """G4 as a map per column: column, distribution map<value, count> of the top k."""
    top = categorical_top(df, columns, k)
    return top.groupBy("column").agg(
        F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))),
                                       lambda s: F.struct(s["value"], s["count"]))).alias("distribution"))


def categorical_summary(df: DataFrame, columns=None) -> DataFrame:
    """Total categories over the columns, plus one text line per column."""
    prof = categorical(df, columns)
    total = prof.select(F.sum("unique_values")).scalar()  # scalar subquery; its exchanges are reused
    return prof.select(
        "column", "unique_values",
        total.cast("long").alias("total_categories"),
        # Fixed value: the per-column summary format.
        F.format_string("Categorical analysis for '%s': %d unique values, most frequent: '%s' (%.1f%%)", "column",
                        "unique_values", "top_value", F.bround("top_percentage", 1)).alias("summary"),
    )
