"""Continuous form of the multi-file ingest (S3): CSV files arriving in a
folder are tagged with their file name and appended to the dataset's parquet
table, exactly once per file (checkpointed file-source offsets).

The schema must be given up front (streams cannot infer per batch); typing
rules are applied per micro-batch with the same column expressions as the
batch path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NULL_TOKENS, coerce_numeric, normalize_null_tokens
from ..sources.csv import SOURCE_FILE


def csv_stream(spark: SparkSession, folder: str, schema: T.StructType, numeric: list[str] | None = None) -> DataFrame:
    raw = (spark.readStream.option("header", True).schema(schema).csv(folder)
           .withColumn(SOURCE_FILE, F.col("_metadata.file_name")))
    cols = []
    for f in raw.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and f.name != SOURCE_FILE:
            c = normalize_null_tokens(c, NULL_TOKENS)
            if numeric and f.name in numeric:
                c = coerce_numeric(c)
        cols.append(c.alias(f.name))
    return raw.select(*cols)


def start_ingest(spark: SparkSession, folder: str, schema: T.StructType, table_path: str, checkpoint: str,
                 numeric: list[str] | None = None, once: bool = True):
    """Start the stream; with ``once`` it processes what is there and stops."""
    q = (csv_stream(spark, folder, schema, numeric).writeStream.format("parquet")
         .option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append"))
    q = q.trigger(availableNow=True) if once else q.trigger(processingTime="10 seconds")
    return q.start()
