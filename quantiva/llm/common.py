"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_dir

# Arrow batches handed to Python are cut at this many bytes, so a worker's
# memory does not follow the length of the documents in a partition.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes as well as by rows (a session setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def packed(value) -> bytes:
    """For a broadcast: pickled with the classes of this package, so that tasks need not have it."""
    return cloudpickle.dumps(value)


def unpacked(shared):
    """The value of a broadcast of ``packed``; call it once a task."""
    return pickle.loads(shared.value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back (lineage is cut)."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that no later step reads, before the session ends."""
    for table in tables:
        spark = table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def lowest(hashes, distinct, n: int):
    """Condition that keeps about the 2n lowest of ``distinct`` different 64-bit hashes (all, if there are not so many),
    so that the first n in their order can be taken from a table of bounded size.  An estimate of ``distinct`` will do:
    fewer than n are kept only if it is twice too high."""
    share = F.least(F.lit(2.0 * n) / F.greatest(distinct, F.lit(1)), F.lit(1.0))
    return hashes.cast("double") <= share * 2.0 ** 64 - 2.0 ** 63


def held_out(id_col: str, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``, equals ``fold`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def text_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not wide and not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col, wide = col.cast(pa.large_string()), True
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Row ranges [a, b) of at most ``most`` bytes each (or one row, if that is longer)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of the smallest width that holds them, byte plane by byte plane, compressed."""
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


__all__ = ["BATCH_BYTES", "bounded_batches", "discard", "ensure_checkpoint_dir", "held_out", "lowest", "pack", "packed", "scratch_dir", "slices", "stored",
           "text_column", "unpack", "unpacked"]
