"""File admission (S5): extension and size checks from file-system metadata only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import list_files

# Accepted extensions and the default size limit (bytes).
SUPPORTED_EXTENSIONS = (".csv", ".xlsx", ".xls")
MAX_FILE_BYTES = 100 * 1024 * 1024


def file_admission(spark: SparkSession, path: str, exts=SUPPORTED_EXTENSIONS, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, length, accepted, reason for every file under ``path``."""
    f = list_files(spark, path)
    ext = F.lower(F.regexp_extract("file_name", r"(\.[^./]+)$", 1))
    ok_ext = ext.isin(list(exts))
    ok_size = F.col("length") <= F.lit(int(max_bytes))
    reason = (F.when(~ok_ext, F.format_string("Unsupported file type: %s. Supported types: %s",
                                              F.when(ext == "", F.lit("(none)")).otherwise(ext), F.lit(", ".join(exts))))
              .when(~ok_size, F.format_string("File too large: %d bytes. Maximum allowed: %d bytes",
                                              F.col("length"), F.lit(int(max_bytes)))))
    return f.select("path", "file_name", "length", (ok_ext & ok_size).alias("accepted"), reason.alias("reason"))
