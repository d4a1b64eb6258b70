"""Profiling and quality aggregates (A1-A15, T6/T8 roles, P8 duplicates).

Per-column counts come from one wide aggregate; exact distinct counts come
from a long form per type family (integral / floating / other) grouped by
(column id, value), which replaces C separate ``countDistinct`` passes (or
one ``Expand`` of rows x C) by one partially aggregated shuffle per family.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.columns import (NESTED_TYPES, as_double, check_columns, col, is_datetime_type,
                                 is_numeric_type, name_at, nan_to_null)
from .roles import numeric_columns

# Fixed widths in bytes used by the data-volume estimate (A4, re-aimed).
FIXED_WIDTH = {
    "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def attach(base: DataFrame, *one_row: DataFrame) -> DataFrame:
    """Add the columns of one-row results to ``base`` as scalar subqueries, one for each result
    (no join, so no nested-loop or cartesian plan)."""
    names, wide = [F.col(f"`{c}`") for c in base.columns], base
    for k, d in enumerate(one_row):
        wide = wide.withColumn(f"__row{k}", d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("s")).scalar())
        names += [F.col(f"__row{k}").getField(c).alias(c) for c in d.columns]
    return wide.select(*names)


def _family(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "integral"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "floating"
    return "other"


def _value_expr(df: DataFrame, name: str, family: str):
    c = col(name)
    dt = df.schema[name].dataType
    if family == "integral":
        return c.cast("long")
    if family == "floating":
        return nan_to_null(c.cast("double"))
    if isinstance(dt, NESTED_TYPES):
        return F.to_json(c)
    return c.cast("string")


def _value_or_digest(df: DataFrame, name: str, family: str):
    """A value to count distinct ones by: of text of 64 characters or more its SHA-256 (64 hex digits, so it
    equals no shorter text), so that whole texts are not shuffled."""
    v = _value_expr(df, name, family)
    return F.when(F.length(v) >= 64, F.sha2(v, 256)).otherwise(v) if family == "other" else v


def _missing(df: DataFrame, name: str):
    """NULL test that also treats NaN as missing."""
    dt = df.schema[name].dataType
    c = col(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """(cid, unique_count): exact non-null distinct values per column."""
    names = df.columns
    if approx:
        row = df.agg(*[F.approx_count_distinct(_value_expr(df, n, _family(df.schema[n].dataType))).alias(f"u{i}")
                       for i, n in enumerate(names)])
        return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("cid"), F.col(f"u{i}").cast("long").alias("unique_count"))
                                             for i in range(len(names))])).alias("r")).select("r.*")
    parts = []
    for fam in ("integral", "floating", "other"):
        ids = [i for i, n in enumerate(names) if _family(df.schema[n].dataType) == fam]
        if not ids:
            continue
        pairs = [F.struct(F.lit(i).alias("cid"), _value_or_digest(df, names[i], fam).alias("v")) for i in ids]
        long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.cid", "p.v").where(F.col("v").isNotNull())
        parts.append(long.distinct().groupBy("cid").agg(F.count(F.lit(1)).alias("unique_count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_counts(df: DataFrame) -> DataFrame:
    """(cid, rows, null_count) from one wide aggregate."""
    names = df.columns
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(_missing(df, n)).alias(f"m{i}") for i, n in enumerate(names)]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("cid"), F.col("rows").alias("rows"),
                                                    F.col(f"m{i}").alias("null_count")) for i in range(len(names))])).alias("r")).select("r.*")


def _meta(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Schema facts known on the driver, as a small literal table."""
    spark = df.sparkSession
    rows = []
    for i, f in enumerate(df.schema.fields):
        if is_numeric_type(f.dataType):
            dtype_role = "numeric"
        elif is_datetime_type(f.dataType):
            dtype_role = "datetime"
        else:
            dtype_role = "other"
        rows.append((i, f.name, f.dataType.simpleString(), f.name in numeric, dtype_role))
    schema = "cid int, column string, dtype string, is_numeric boolean, dtype_role string"
    return spark.createDataFrame(rows, schema)


def schema_overview(df: DataFrame, approx: bool = False, numeric: list[str] | None = None) -> DataFrame:
    """A5: column, dtype, null_count, null_percentage, unique_count, unique_percentage, is_numeric."""
    numeric = numeric_columns(df) if numeric is None else numeric
    base = (column_counts(df).join(distinct_counts(df, approx), "cid", "left")
            .join(F.broadcast(_meta(df, numeric)), "cid"))  # meta: one row per column
    return base.select(
        "cid", "column", "dtype", "null_count",
        (F.try_divide(F.col("null_count"), F.col("rows")) * 100).alias("null_percentage"),
        F.coalesce(F.col("unique_count"), F.lit(0)).cast("long").alias("unique_count"),
        (F.try_divide(F.coalesce(F.col("unique_count"), F.lit(0)), F.col("rows")) * 100).alias("unique_percentage"),
        "is_numeric", "rows", "dtype_role",
    )


def column_roles(df: DataFrame, numeric: list[str] | None = None, counts: bool = False) -> DataFrame:
    """T6 + T8: column, dtype, is_numeric_strict, role (numeric/datetime/categorical/text); with
    ``counts`` also null_count and unique_count, which the roles are derived from."""
    ov = schema_overview(df, numeric=numeric)
    role = (F.when(F.col("dtype_role") == "numeric", "numeric")
            .when(F.col("dtype_role") == "datetime", "datetime")
            .when(F.try_divide(F.col("unique_count"), F.col("rows")) < 0.5, "categorical")
            .otherwise("text"))
    return ov.select("cid", "column", "dtype", F.col("is_numeric").alias("is_numeric_strict"), role.alias("role"),
                     *(["null_count", "unique_count"] if counts else []))


def _row_hashes(df: DataFrame) -> list:
    """Two 64-bit hashes of a row and its pattern of NULLs: equal rows (NULLs equal) have equal ones."""
    cols = []
    for f in df.schema.fields:
        c = col(f.name)
        cols.append(c + F.lit(0.0).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else
                    F.to_json(c) if isinstance(f.dataType, T.MapType) else c)  # -0.0 is 0.0
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(nulls, *cols).alias("__h1"), F.xxhash64(F.lit(0x9E3779B9), *cols, nulls).alias("__h2")]


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Groups of identical rows (NULLs equal) with their count, only groups of 2+.

    The 128-bit hashes of the rows are grouped first (16 bytes shuffled per
    row, less after partial aggregation); full rows are joined to the repeated
    hashes -- broadcast when these are few -- and grouped exactly.
    """
    cols = [col(n) for n in df.columns]
    hashed = df.select(*_row_hashes(df), *cols)
    repeated = hashed.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    cand = hashed.join(repeated, ["__h1", "__h2"], "left_semi").drop("__h1", "__h2")
    return cand.groupBy(*cols).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """A3: one row, duplicate_rows = rows after their first occurrence.

    Counted on 128-bit hashes of the rows alone (two different rows among n are taken for equal with a
    chance of about n^2 / 2^129); no row is shuffled."""
    g = df.select(*_row_hashes(df)).groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def duplicate_records(df: DataFrame) -> DataFrame:
    """Each duplicated record once, with how many times it occurs."""
    return duplicate_groups(df)


def missing_cells(df: DataFrame) -> DataFrame:
    """A2: missing_cells and missing_percentage of rows x columns."""
    names = df.columns
    total = sum((F.count_if(_missing(df, n)) for n in names), F.lit(0)) if names else F.lit(0)
    row = df.agg(F.count(F.lit(1)).alias("rows"), total.alias("missing_cells"))
    return row.select(
        F.col("missing_cells").cast("long").alias("missing_cells"),
        (F.try_divide(F.col("missing_cells"), F.col("rows") * F.lit(len(names))) * 100).alias("missing_percentage"),
    )


def value_bytes(f: T.StructField):
    """Aggregate: fixed width x non-null values, or the bytes of text (nested values as JSON)."""
    c = col(f.name)
    w = FIXED_WIDTH.get(f.dataType.simpleString(), 16 if isinstance(f.dataType, T.DecimalType) else None)
    if w is not None:
        return F.count(c) * F.lit(w)
    return F.coalesce(F.sum(F.octet_length(c if isinstance(f.dataType, T.StringType) else F.to_json(c))), F.lit(0))


def _bytes_agg(df: DataFrame):
    parts = [value_bytes(f) for f in df.schema.fields]
    return (sum(parts[1:], parts[0]) if parts else F.lit(0)).cast("long")


def estimated_bytes(df: DataFrame) -> DataFrame:
    """A4 re-aimed: data volume = fixed widths x non-null cells + bytes of text values."""
    return df.agg(_bytes_agg(df).alias("estimated_bytes")).select(
        "estimated_bytes", (F.col("estimated_bytes") / 1024 / 1024).alias("estimated_mb"))


def basic_info(df: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """A1: total_rows, total_columns, numeric_columns, categorical_columns,
    missing_values, estimated_bytes, duplicate_rows (one row).  One scan counts
    rows, missing cells and bytes, another the duplicates."""
    numeric = numeric_columns(df) if numeric is None else numeric
    n_cols = len(df.columns)
    missing = sum((F.count_if(_missing(df, n)) for n in df.columns), F.lit(0))
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"), missing.alias("missing_cells"), _bytes_agg(df).alias("estimated_bytes"))
    return attach(counts, duplicate_rows(df)).select(
        F.col("total_rows").cast("long").alias("total_rows"),
        F.lit(n_cols).cast("long").alias("total_columns"),
        F.lit(len(numeric)).cast("long").alias("numeric_columns"),
        F.lit(n_cols - len(numeric)).cast("long").alias("categorical_columns"),
        F.col("missing_cells").cast("long").alias("missing_values"),
        "estimated_bytes", "duplicate_rows",
    )


def quality_report(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and %, duplicates, columns with any / all missing,
    numeric and categorical counts by dtype, data volume (one row)."""
    names = df.columns
    counts = df.agg(F.count(F.lit(1)).alias("rows"), _bytes_agg(df).alias("estimated_bytes"),
                    *[F.count_if(_missing(df, n)).alias(f"m{i}") for i, n in enumerate(names)])
    m = [F.col(f"m{i}") for i in range(len(names))]
    listed = lambda test: F.array_compact(F.array(*[F.when(test(m[i]), F.lit(n)) for i, n in enumerate(names)]))
    lists = counts.select("rows", "estimated_bytes", sum(m, F.lit(0)).alias("missing"), listed(lambda c: c > 0).alias("_any"),
                          listed(lambda c: (c == F.col("rows")) & (F.col("rows") > 0)).alias("_all"))
    n_num = sum(1 for f in df.schema.fields if is_numeric_type(f.dataType) and not isinstance(f.dataType, T.BooleanType))
    n_cat = sum(1 for f in df.schema.fields if isinstance(f.dataType, T.StringType))
    res = attach(lists, duplicate_rows(df))
    return res.select(
        F.col("rows").cast("long").alias("total_rows"),
        F.lit(len(names)).cast("long").alias("total_columns"),
        (F.try_divide(F.col("missing"), F.col("rows") * F.lit(len(names))) * 100).alias("missing_data_percentage"),
        "duplicate_rows", F.col("missing").cast("long").alias("missing_values"),
        F.col("_any").alias("columns_with_missing_data"),
        F.col("_all").alias("columns_all_missing"),
        F.lit(n_num).cast("long").alias("numeric_columns_count"),
        F.lit(n_cat).cast("long").alias("categorical_columns_count"),
        "estimated_bytes",
    )


def sample_values(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """(cid, rank, value): first n non-null values per column by a stated order.

    ``row_number() <= n`` per column is planned with a partial window-group
    limit before the shuffle, so each task sends at most n rows per column.
    """
    names = df.columns
    order_col = col(order_by) if order_by else None
    pairs = [F.struct(F.lit(i).alias("cid"), col(c).cast("string").alias("value"),
                      (order_col.cast("string") if order_col is not None else col(c).cast("string")).alias("o"))
             for i, c in enumerate(names) if not isinstance(df.schema[c].dataType, NESTED_TYPES)]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where(F.col("value").isNotNull())
    w = Window.partitionBy("cid").orderBy("o", "value")
    return long.select("cid", "value", F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)


def column_listing(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """Schema overview + sample_values (first n non-null values, stated order)."""
    ov = schema_overview(df)
    s = sample_values(df, n, order_by).groupBy("cid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("sample_values"))
    return ov.join(s, "cid", "left").drop("rows", "dtype_role")


def _least_values(values: DataFrame, limit: int) -> DataFrame:
    """At most ``limit + 1`` values (one column) from each task, among them its ``limit`` least distinct ones.

    Each Arrow batch is merged into a sorted set that is cut again, so a task holds a batch and the set.
    The spare value makes up for 0.0 and -0.0, which are two values to Arrow and one to Spark.
    """
    def run(batches):
        kept = None
        for b in batches:
            own = b.column(0).unique()
            kept = own if kept is None else pa.concat_arrays([kept, own]).unique()
            if len(kept) > limit + 1:
                kept = kept.take(pc.sort_indices(kept)[: limit + 1])
        if kept is not None:
            yield pa.RecordBatch.from_arrays([kept], ["value"])

    return values.mapInArrow(run, values.schema)


def unique_values(df: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """Distinct non-null values, first ``limit`` in ascending order (1..1000).

    Numbers, text, dates and times are cut to the least values in each task before anything is shuffled;
    values of other types are grouped whole."""
    check_columns(df, [column])
    if not 1 <= int(limit) <= 1000:
        raise ValidationError("limit must be between 1 and 1000")
    values = df.select(col(column).alias("value")).where(F.col("value").isNotNull())
    if isinstance(df.schema[column].dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        values = _least_values(values, int(limit))
    return values.distinct().orderBy("value").limit(int(limit))


def column_info(df: DataFrame, column: str, limit: int = 100) -> DataFrame:
    """One column's overview row with up to ``limit`` unique values and 10 samples."""
    check_columns(df, [column])
    one = df.select(col(column))
    ov = schema_overview(one).drop("rows", "dtype_role", "cid")
    uv = unique_values(one, column, limit).agg(
        F.array_sort(F.collect_list(F.col("value").cast("string"))).alias("unique_values"))
    smp = sample_values(one, 10).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("sample_values"))
    return attach(ov, uv, smp)


def column_info_maps(df: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """A10: column_types, missing_values, unique_counts maps and the role lists (one row)."""
    t = column_roles(df, numeric, counts=True)

    def names_where(role):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("cid", "column")))),
                           lambda s: s["column"])

    return t.agg(
        F.count(F.lit(1)).cast("long").alias("total_columns"),
        names_where("numeric").alias("numeric_columns"),
        names_where("categorical").alias("categorical_columns"),
        names_where("datetime").alias("datetime_columns"),
        names_where("text").alias("text_columns"),
        F.map_from_entries(F.collect_list(F.struct("column", "dtype"))).alias("column_types"),
        F.map_from_entries(F.collect_list(F.struct("column", "null_count"))).alias("missing_values"),
        F.map_from_entries(F.collect_list(F.struct("column", "unique_count"))).alias("unique_counts"),
    )


def variable_summaries(df: DataFrame, limit: int = 5, numeric: list[str] | None = None) -> DataFrame:
    """Mean, std, min, max, missing, count of the first ``limit`` numeric columns."""
    numeric = (numeric_columns(df) if numeric is None else numeric)[:limit]
    if not numeric:
        raise ValidationError("No numeric columns")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(numeric):
        x = as_double(df, n)
        aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"mi{i}"),
                 F.max(x).alias(f"ma{i}"), F.count(x).alias(f"c{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("cid"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                     F.col(f"mi{i}").alias("min"), F.col(f"ma{i}").alias("max"),
                     (F.col("rows") - F.col(f"c{i}")).alias("missing"), F.col(f"c{i}").alias("count"))
            for i in range(len(numeric))]
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select(name_at(numeric, F.col("cid")).alias("column"), "mean", "std", "min", "max",
                      F.col("missing").cast("long").alias("missing"), F.col("count").cast("long").alias("count"))


def dataset_context(df: DataFrame, max_columns: int = 15) -> DataFrame:
    """One text line per column (first ``max_columns`` in schema order)."""
    ov = schema_overview(df).where(F.col("cid") < max_columns)
    # Fixed value: the column line format.
    return ov.select("cid", "column", F.format_string("- %s: %s, %.1f%% null, %d unique values", "column", "dtype",
                                                      F.bround("null_percentage", 1), "unique_count").alias("line"))


def drop_empty(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop all-null rows, then all-null columns; returns (clean, report).

    Which columns are empty needs one aggregate before the output schema is
    known; the report row has rows_removed and columns_removed.
    """
    names = df.columns
    not_all_null = F.lit(False)
    for n in names:
        not_all_null = not_all_null | ~_missing(df, n)
    kept = df.where(not_all_null)
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(not_all_null).alias("kept"),
                 *[F.count_if(~_missing(df, n)).alias(f"c{i}") for i, n in enumerate(names)]).collect()[0]
    empty_cols = [n for i, n in enumerate(names) if row[f"c{i}"] == 0]
    clean = kept.drop(*empty_cols)
    spark = df.sparkSession
    report = spark.createDataFrame([(int(row["rows"] - row["kept"]), len(empty_cols), empty_cols)],
                                   "rows_removed long, columns_removed long, removed_columns array<string>")
    return clean, report
