"""Dataset persistence (S7, S8, S12): parquet data + one-row JSON metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFoundError


def data_path(path: str) -> str:
    return f"{path}/data"


def metadata_path(path: str) -> str:
    return f"{path}/metadata"


def save_data(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(data_path(path))


def save_metadata(row: DataFrame, path: str) -> None:
    """A one-row table as JSON, stamped with saved_at."""
    row.withColumn("saved_at", F.current_timestamp().cast("string")).coalesce(1).write.mode("overwrite").json(metadata_path(path))


def save_dataset(df: DataFrame, path: str, metadata: dict | None = None) -> DataFrame:
    """Write ``df`` to ``path/data`` (parquet) and a metadata row to ``path/metadata``: the given values as
    columns (lists as arrays), saved_at and data_shape; returns the metadata row."""
    save_data(df, path)
    spark = df.sparkSession
    written = spark.read.parquet(data_path(path))
    extra = {k: F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
             for k, v in (metadata or {}).items() if v is not None}
    save_metadata(written.agg(F.count(F.lit(1)).alias("rows")).select(
        F.array(F.col("rows"), F.lit(len(df.columns)).cast("long")).alias("data_shape"),
        *[v.alias(k) for k, v in extra.items()]), path)
    return spark.read.json(metadata_path(path))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(data, metadata); NotFoundError when either part is missing."""
    if not (_exists(spark, data_path(path)) and _exists(spark, metadata_path(path))):
        raise NotFoundError(f"No dataset stored at {path}")
    return spark.read.parquet(data_path(path)), spark.read.json(metadata_path(path))


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, file_name, length, modificationTime of the files under ``path``.

    ``binaryFile`` with the content column pruned: only file-system metadata
    is read, never the bytes.
    """
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length", "modificationTime")


def storage_stats(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Per file: file_name, size_bytes, size_mb, modified."""
    f = list_files(spark, path, glob)
    return f.select("file_name", F.col("length").alias("size_bytes"), (F.col("length") / 1024 / 1024).alias("size_mb"),
                    F.col("modificationTime").alias("modified"))
