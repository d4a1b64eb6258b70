"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens).  A
document's content digest is the SHA-256 of its normalised content, the
tokenizer digest the SHA-256 of the vocabulary file, so a stored count is
never used for another text or another tokenizer version.  One run groups the
documents by content digest, keeps the digests that the cache lacks, encodes
each of these texts once, appends the counts, and joins every document to its
count.

Normalisation is only "null is the empty text": any further folding of
characters would change the counts that the library gives.

Within one task the sentencepiece BPE model is asked once for each distinct
word (see ``_WordCounts``); texts for which that is not provably the same go
to the library whole.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch_dir

CACHE_SCHEMA = "content_digest binary, tokenizer_digest binary, n_tokens bigint"
_MEMO = 400_000
_CHUNK = re.compile(" ")


def tokenizer_digest(vocabulary: bytes) -> bytes:
    return hashlib.sha256(vocabulary).digest()


class _WordCounts:
    """Counts of a sentencepiece BPE model, with a bounded memo of words.

    BPE joins two neighbours only if the joined string is a piece.  When no
    piece holds the space mark after another character, nothing is ever joined
    across the space before a word, so a text whose spaces are all single is
    the concatenation of its words, each with the mark in front (the first
    gets it as the dummy prefix).  The model is checked for this when loaded;
    texts with other runs of spaces, or the mark itself, are encoded whole.
    """

    def __init__(self, proto: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        mark = "▁"
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())
                  if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i))]
        plain = all(mark not in p.lstrip(mark) for p in pieces)
        # the same for a few probes: the prefix is added, spaces are kept, nothing is folded
        probes = ["a b", "A\nb c", "Été ﬁn", "x y z", "İ Å　q", "1﻿ ­2"]
        self.mark, self.memo = mark, {}
        self.by_word = plain and all(self.sp.encode(p) == [i for w in p.split(" ") for i in self.sp.encode(w)]
                                     for p in probes) and self.sp.decode(self.sp.encode(probes[2])) == probes[2]

    def counts(self, texts: list[str]) -> list[int]:
        memo, out, rest = self.memo, [-1] * len(texts), []
        if len(memo) > _MEMO:
            memo.clear()
        parts = {}
        for k, t in enumerate(texts):
            if not t:
                out[k] = 0
            elif not self.by_word or "  " in t or t[0] == " " or t[-1] == " " or self.mark in t:
                rest.append(k)
            else:
                parts[k] = t.split(" ")
        new = list({w for ws in parts.values() for w in ws if w not in memo})
        for a in range(0, len(new), 4096):
            some = new[a:a + 4096]
            memo.update(zip(some, map(len, self.sp.encode(some, num_threads=1))))
        for k, ws in parts.items():
            out[k] = sum(map(memo.__getitem__, ws))
        for a in range(0, len(rest), 32):
            some = rest[a:a + 32]
            for k, ids in zip(some, self.sp.encode([texts[k] for k in some], num_threads=1)):
                out[k] = len(ids)
        return out


class _JsonCounts:
    """Counts of a tokenizers file: no added tokens, special strings as the file's default says."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(data.decode("utf-8"))
        self.t.no_truncation()
        self.t.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self.t.encode(t, add_special_tokens=False).ids) for t in texts]


def counter(vocabulary: bytes, kind: str):
    return _JsonCounts(vocabulary) if kind == "json" else _WordCounts(vocabulary)


def encode_counts(texts: DataFrame, vocabulary: bytes, kind: str) -> DataFrame:
    """(content_digest, text) -> rows of the cache."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # one vocabulary file
    version = tokenizer_digest(vocabulary)

    def run(batches):
        c = counter(shared.value, kind)
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("content_digest"), pa.array([version] * len(texts), pa.binary()),
                 pa.array(c.counts(texts), pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    return texts.select("content_digest", "text").mapInArrow(run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, vocabulary_path: str, cache_path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, content_digest, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per input row.

    ``vocabulary_path`` is read on the driver (a ``.model`` file for
    sentencepiece, a ``.json`` file for tokenizers) and sent to the tasks.
    ``cache_path`` names the cache table (created if it does not exist; None:
    a new one in the scratch folder); counts of new texts are appended before
    this function returns.  An append that ran twice does no harm: a digest
    pair always has the same count and is read once.

    Null text counts as empty (0 bytes, 0 tokens); null or repeated ids and
    repeated rows pass through, one row each; an empty table gives an empty
    result; other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    kind = "json" if vocabulary_path.endswith(".json") else "model"
    version = F.lit(bytearray(tokenizer_digest(vocabulary)))
    cache_path = cache_path or scratch_dir(spark, "token-cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def known():
        return (spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == version)
                .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")))

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    content = docs.select(text.alias("text")).withColumn("content_digest", F.unhex(F.sha2("text", 256)))
    distinct = content.groupBy("content_digest").agg(F.first("text").alias("text"))
    misses = distinct.join(known(), "content_digest", "left_anti")
    encode_counts(misses, vocabulary, kind).write.mode("append").option("compression", "zstd").parquet(cache_path)

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("content_digest"),
                       F.octet_length(text).cast("bigint").alias("n_bytes"))
    return (rows.join(known(), "content_digest", "left")
            .select("doc_id", "content_digest", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
