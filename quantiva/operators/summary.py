"""Composed reports (A12, A14, A15): several operators combined into one result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric_type
from ..sources import csv as csvsrc
from ..sources import storage
from . import correlate, outliers, profile
from .roles import numeric_columns


# The recommendations of the analysis summary.
RECOMMENDATIONS = [
    "Start with descriptive statistics to understand your data",
    "Check for correlations between numeric variables",
    "Identify and investigate outliers",
    "Analyze distributions for normality assumptions",
    "Use hypothesis testing to validate relationships",
]


def _kv(df: DataFrame, section: str, item_col, cols: list[str], texts: tuple = ()) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(
        F.lit(section).alias("section"), F.concat_ws(".", item_col, F.lit(c)).alias("item"),
        (F.lit(None) if c in texts else F.col(c)).cast("double").alias("value"),
        (F.col(c) if c in texts else F.lit(None)).cast("string").alias("text")) for c in cols])).alias("r")).select("r.*")


def analysis_summary(df: DataFrame) -> DataFrame:
    """Long (section, item, value, text): basic info, schema of every column, first-10 variable
    summaries, correlation counts and the strongest pair, IQR outliers of the first numeric column,
    recommendations."""
    numeric = numeric_columns(df)
    spark = df.sparkSession
    parts = [_kv(profile.basic_info(df, numeric), "basic", F.lit("dataset"),
                 ["total_rows", "total_columns", "numeric_columns", "categorical_columns", "missing_values", "duplicate_rows"]),
             _kv(profile.schema_overview(df, numeric=numeric).withColumn("is_numeric", F.col("is_numeric").cast("int")), "schema",
                 F.col("column"), ["dtype", "null_count", "null_percentage", "unique_count", "unique_percentage", "is_numeric"], ("dtype",))]
    if numeric:
        parts.append(_kv(profile.variable_summaries(df, 10, numeric), "variables", F.col("column"),
                         ["mean", "std", "min", "max", "missing", "count"]))
        o = outliers.outliers(df, numeric[:1], ["iqr"])
        parts.append(_kv(o, "outliers", F.col("column"), ["count", "percentage", "lower_bound", "upper_bound"]))
    if len(numeric) >= 2:
        pairs = correlate.correlation(df, numeric, "pearson")
        best = correlate.top_pairs(pairs, 1).select(
            F.col("correlation").alias("strongest_r"), F.col("column1").alias("strongest_column1"),
            F.col("column2").alias("strongest_column2"), F.col("strength").alias("strongest_strength"),
            F.col("direction").alias("strongest_direction"))
        s = profile.attach(correlate.corr_summary(pairs), best)
        parts.append(_kv(s, "correlation", F.lit("pairs"), ["total_pairs", "strong_correlations", *best.columns], tuple(best.columns[1:])))
    parts.append(spark.createDataFrame([("recommendations", str(k + 1), None, t) for k, t in enumerate(RECOMMENDATIONS)],
                                       "section string, item string, value double, text string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_info(df: DataFrame, metadata: dict | None = None, folder: str | None = None) -> DataFrame:
    """A15, one row: rows, columns, data volume, missing and duplicates, upload metadata (file_names, saved_at,
    NULL without it), the schema overview as an array of structs, the names by role, and the number of files and
    bytes of the stored data when a folder is given."""
    numeric = numeric_columns(df)
    info = profile.basic_info(df, numeric).select(
        "total_rows", "total_columns", "estimated_bytes", "missing_values", "duplicate_rows")
    meta = metadata or {}
    info = info.withColumns({"file_names": F.lit(meta.get("file_names")).cast("array<string>") if meta.get("file_names") is None
                             else F.array(*[F.lit(x) for x in meta["file_names"]]),
                             "saved_at": F.lit(meta.get("saved_at")).cast("string")})
    over = profile.column_roles(df, numeric, counts=True)
    named = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("cid", "column")))),
                                     lambda s: s["column"])
    schema = over.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cid", "column", "dtype", "null_count", "unique_count"))),
                    lambda s: F.struct(s["column"].alias("column"), s["dtype"].alias("dtype"), s["null_count"].alias("null_count"),
                                       s["unique_count"].alias("unique_count"))).alias("columns"),
        named("numeric").alias("numeric_columns"), named("categorical").alias("categorical_columns"),
        named("datetime").alias("datetime_columns"), named("text").alias("text_columns"))
    extra = [schema]
    if folder:
        extra.append(storage.storage_stats(df.sparkSession, folder).agg(
            F.sum("size_bytes").alias("storage_bytes"), F.count(F.lit(1)).alias("storage_files")))
    return profile.attach(info, *extra)


def dataset_context_record(df: DataFrame, file_names: list[str] | None = None) -> DataFrame:
    """A13 as one record: rows, columns, file_names, numeric and categorical column names (by dtype),
    missing_values, missing_percentage, duplicate_rows."""
    q = profile.quality_report(df)
    numeric = [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and not isinstance(f.dataType, T.BooleanType)]
    categorical = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    names = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return q.select(
        F.col("total_rows").alias("rows"), F.col("total_columns").alias("columns"), names(file_names or []).alias("file_names"),
        names(numeric).alias("numeric_columns"), names(categorical).alias("categorical_columns"), "missing_values",
        F.col("missing_data_percentage").alias("missing_percentage"), "duplicate_rows")


def ingest(spark: SparkSession, paths, dest: str, narrow: bool = False) -> DataFrame:
    """Read CSVs (S3), type them (T3-T5), save them as Parquet (S7), and profile what was saved:
    quality (A9) and roles (A10); returns the upload report (one row), which is also the metadata."""
    df = csvsrc.read_csv(spark, paths, narrow=narrow)
    storage.save_data(df, dest)
    data = spark.read.schema(df.schema).parquet(storage.data_path(dest))
    numeric = numeric_columns(data)
    q = profile.quality_report(data)
    files = data.groupBy(csvsrc.SOURCE_FILE).agg(F.count(F.lit(1)).alias("n")).agg(
        F.array_sort(F.collect_list(csvsrc.SOURCE_FILE)).alias("file_names"))  # one name per input file, after a shuffle
    roles = profile.column_info_maps(data, numeric).select("numeric_columns", "categorical_columns")
    rep = profile.attach(q, files, roles).select(
        "total_rows", "total_columns", "file_names", "missing_data_percentage", "duplicate_rows", "numeric_columns",
        "categorical_columns")
    storage.save_metadata(rep, dest)
    return spark.read.schema(rep.schema).json(storage.metadata_path(dest))
