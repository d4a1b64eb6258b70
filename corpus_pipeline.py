"""Corpus pipeline: documents in, token ids of clean, distinct, uncontaminated documents out.

Each stage takes the documents that the one before kept, written as Parquet
and read again, and calls one operator of ``quantiva.llm``.  All but the last
return the columns of documents; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantiva.llm import byte_bpe, decontaminate, jaccard_join, language_id, line_dedup
from quantiva.llm.common import stored
from quantiva.session import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept (null texts and texts without letters go)."""
    return language_id.identify(docs, columns=COLUMNS).filter(~F.col("rejected")).select(*COLUMNS)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated three-line windows; those that lose all their text go."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.filter((F.col("n_removed") == 0) | F.col("text").rlike("\\S")).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 80 % of five-word shingles: the one with the smallest id."""
    return jaccard_join.keep_one(docs.select(*COLUMNS), n=5, percent=80)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words (or a whole shorter item) of a benchmark item."""
    found = decontaminate.find_passages(docs, read_table(spark, sf_dir, "benchmark"), columns=COLUMNS)
    return found.filter("n_hit = 0").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every document that is left."""
    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_duplicates", remove_near_duplicates),
    ("decontaminate", remove_contaminated),
    ("byte_bpe", encode),
]

# Language models, connected components and BPE merges are not expressed in SQL;
# tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is stored in the shared folder before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
