"""Content-addressed WARC archive.

Two Parquet tables: ``payloads`` holds the bytes of each distinct payload
once under its SHA-256, ``records`` holds every record's exact header bytes
with the digest of its payload.  Records are rebuilt by a join, and the bytes
read back are digested again and compared with their address.

All work is done with built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The WARC 1.1 record layout and RFC 4648's base32 alphabet.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_OF_CONV = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: four groups of ten hex digits are eight base32 digits each."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), BASE32_OF_CONV, BASE32)


def build_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id, payload_sha256, payload_bytes, payload (null in revisits), header (exact bytes).

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes the
    one with the smallest id is a response and the others are revisits of it;
    smaller payloads are always responses.  Null payload: empty.  Null ids
    come after all others (a group of null ids alone has only responses), and
    rows that repeat the smallest id are all responses.  Null URL: no target
    line.  The header ends with the blank line that precedes the payload.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("payload_sha256"),
                       sha1_base32(F.col("payload")).alias("sha1"),
                       F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    # the payload itself never crosses a shuffle here: digests and ids do
    first = (rows.filter((F.col("payload_bytes") >= min_revisit_bytes) & F.col("page_id").isNotNull())
             .groupBy("payload_sha256").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
             .filter("n > 1").drop("n"))
    narrow = rows.drop("payload").join(first, "payload_sha256", "left")
    narrow = narrow.withColumn(
        "refers_to", F.when((F.col("payload_bytes") >= min_revisit_bytes)
                            & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))), F.col("first_id")))
    return narrow.withColumn("header", _header(date))


def _uuid(c: Column) -> Column:
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(c.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in
                                                           ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header(date: str) -> Column:
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    one_line = F.regexp_replace("url", "[\\x00-\\x20\\x7f]+", "%20")
    return F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _uuid(F.col("page_id"))),
        F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit("")),
        F.coalesce(line("WARC-Target-URI", one_line), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _uuid(F.col("refers_to"))),
                                 line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
                                 line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF)).cast("binary")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write ``path``/payloads and ``path``/records.

    Payloads are grouped by digest before they are stored; two different
    payloads under one digest or a length that differs end the job with an
    error.  An empty input writes empty tables.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary"))
    store = (pages.select(payload.alias("payload")).withColumn("payload_sha256", F.unhex(F.sha2("payload", 256)))
             .groupBy("payload_sha256").agg(F.first("payload").alias("payload"), F.min(F.octet_length("payload")).alias("a"),
                                            F.max(F.octet_length("payload")).alias("b")))
    store = store.select("payload_sha256", F.when(F.col("a") == F.col("b"), F.col("payload")).otherwise(
        F.raise_error(F.lit("payload digest clash"))).alias("payload"))
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")
    build_records(pages, id_col, url_col, payload_col, min_revisit_bytes).select("payload_sha256", "header") \
        .write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: header fields parsed, payload joined by digest and verified.

    Columns: page_id, url, record_type, refers_to, payload_sha256, header, payload (also of
    revisits, taken from the record they refer to), payload_bytes, payload_digest (of the bytes
    read).  Bytes that do not have the digest of their address or of the header raise an error.
    """
    store = spark.read.schema("payload_sha256 binary, payload binary").parquet(f"{path}/payloads")
    # one digest per stored payload, not per record
    store = store.withColumn("payload_digest", F.when(
        F.unhex(F.sha2("payload", 256)) == F.col("payload_sha256"), sha1_base32(F.col("payload"))).otherwise(
        F.raise_error(F.lit("stored payload does not match its digest"))))
    store = store.withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    records = spark.read.schema("payload_sha256 binary, header binary").parquet(f"{path}/records")
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1)
    parsed = records.select(
        "payload_sha256", "header",
        F.nullif(field("X-Page-ID"), F.lit("")).cast("bigint").alias("page_id"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"), field("WARC-Type").alias("record_type"),
        F.nullif(field("X-Refers-To-Page-ID"), F.lit("")).cast("bigint").alias("refers_to"),
        F.regexp_extract(text, "\\r\\nWARC-Payload-Digest: sha1:([A-Z2-7]*)\\r\\n", 1).alias("digest")).drop("_")
    joined = parsed.join(store, "payload_sha256")
    return joined.select(
        "page_id", "url", "record_type", "refers_to", "payload_sha256", "header", "payload",
        "payload_bytes",
        F.when(F.col("payload_digest") == F.col("digest"), F.col("payload_digest")).otherwise(
            F.raise_error(F.lit("payload does not match the record's digest"))).alias("payload_digest"))


def record_bytes(records: DataFrame) -> DataFrame:
    """Exact bytes of each record as it stands in a WARC file (a revisit has no body)."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return records.withColumn("record", F.concat("header", body, F.lit(CRLF * 2).cast("binary")))
