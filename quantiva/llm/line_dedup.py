"""Removal of repeated passages by overlapping three-line windows (built-in functions only).

Every run of three consecutive lines is a window.  Windows that occur more
than once anywhere are found by their digests; the first occurrence (smallest
document id, then position) stays, and all lines that any later occurrence
covers are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 3


def _key(id_col: str, text_col: str):
    """Digest of id and text: a key without nulls; rows equal in both are one document."""
    text = F.col(f"`{text_col}`")
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\x01")),
                                     F.coalesce(text, F.lit("")))))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """row_key and the sorted positions (from 0) of the lines to remove, for documents that lose any."""
    base = docs.select(_key(id_col, text_col).alias("row_key"), F.col(f"`{id_col}`").alias("doc_id"),
                       F.split(F.col(f"`{text_col}`").cast("string"), "\n", -1).alias("lines"))
    base = base.filter(F.size("lines") >= window)
    runs = base.select("row_key", "doc_id", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("lines") - (window - 1)),
        lambda i: F.concat_ws("\n", F.slice(F.col("lines"), i, window)))).alias("pos", "run"))
    hashed = runs.filter(F.col("run").rlike("[^\\s]")).select(
        "row_key", "doc_id", "pos", F.unhex(F.md5("run")).alias("h"))
    hashed = stored(hashed, "line-windows")
    # null ids sort last: (is null, id, key, position)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "pos")
    repeated = (hashed.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                .filter(F.col("first") != F.col("last")).select("h", "first.row_key", "first.pos")
                .withColumnsRenamed({"row_key": "first_key", "pos": "first_pos"}))
    later = (hashed.join(repeated, "h")
             .filter((F.col("row_key") != F.col("first_key")) | (F.col("pos") != F.col("first_pos"))))
    # starts become covered positions once, per document, after the shuffle
    return (later.groupBy("row_key").agg(F.collect_set("pos").alias("starts"))
            .select("row_key", F.sort_array(F.array_distinct(F.flatten(F.transform(
                "starts", lambda p: F.sequence(p, p + (window - 1)))))).alias("removed")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The input with the text shortened, plus n_lines, n_removed.

    Lines are separated by a line feed and compared exactly; windows of only
    white space do not count.  Null text stays null (0 lines); an empty text
    has one empty line; documents of fewer than three lines are unchanged.
    Rows that repeat an id and its text are one document and stay alike.  Ties
    between documents with the same id are ordered by a digest of the text;
    null ids come last.  A document whose every line goes gets an empty text.
    Input columns called n_lines or n_removed are replaced.
    """
    removed = covered_lines(docs, id_col, text_col, window)
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _key(id_col, text_col).alias("row_key"))
    both = packed.join(removed, "row_key", "left")
    old = F.col("row").getField(text_col)
    both = both.withColumn("lines", F.split(old.cast("string"), "\n", -1))  # once, not for each line
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed")),
                       lambda i: F.get(F.col("lines"), i))
    new = F.when(F.col("removed").isNull(), old).otherwise(F.concat_ws("\n", kept))
    keep = [c for c in names if c.lower() not in ("n_lines", "n_removed")]
    return both.select(
        *[(new if c == text_col else F.col("row").getField(c)).alias(c) for c in keep],
        F.when(old.isNull(), 0).otherwise(F.size("lines")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"))
