"""Registered queries of the training-data operators, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import (ann_partitions, byte_bpe, decontaminate, jaccard_join, language_id, line_dedup, lm_interpolation,
               periodic_runs, personal_data, quality_cnn, token_counts, warc, whitening)
from .common import scratch_dir


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_archive(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS h, body FROM p),
f AS (SELECT body, min(page_id) AS first_id FROM p GROUP BY body)
SELECT d.page_id, d.payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(d.h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS BIGINT), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN d.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM d JOIN f USING (body)"""


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs, n=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_id",
                                                                      "component_size")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_partitions.search(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
                                 F.col("id") % 20 == 0, k=20)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs, columns=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("bigint").alias("n_bytes_left"),
                      F.sha2(F.col("text"), 256).alias("text_sha256"))


SQL_OP5 = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i AS pos, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS run
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k
      FROM w WHERE regexp_matches(run, '[^\\s]')),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM r WHERE k > 1)
      GROUP BY doc_id),
j AS (SELECT d.doc_id, d.text, l.lines, coalesce(c.gone, []) AS gone
      FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
k AS (SELECT doc_id, lines, gone, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(
        list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]), chr(10)) END AS t
      FROM j)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(len(gone) AS BIGINT) AS n_removed,
  CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes_left, sha256(t) AS text_sha256 FROM k"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, read_table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


SQL_OP7 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, w[i : i + least(10, len(w)) - 1] AS run
        FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, n, i, w[i : i + n - 1] AS run
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, i, dwin.n AS n FROM dwin JOIN win ON dwin.n = win.n AND dwin.run = win.run),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                           keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_interpolation.score(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cnn.score(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.find_spans(docs, columns=["doc_id"]).withColumn("base", F.filter("spans", lambda s: s["base"]))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def with_periods(docs: DataFrame) -> DataFrame:
    """The query's input: documents whose crc32 h of the id ends in 0 repeat a stretch of their words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(s):
        w, n, g = s["w"], F.size(s["w"]).cast("bigint"), F.floor(s["h"] / 10)
        a = F.when(n > 0, g % F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0))),
            lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))

    new = F.transform(F.array(F.struct(words.alias("w"), h.alias("h"))), repeated)[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), F.coalesce(new, F.lit("")))
                       .otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_periods(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find(docs, columns=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("_l"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("_l.s")).alias("start"), F.col("_l.l").alias("length"), (-F.col("_l.p")).alias("period"),
        F.floor(1000 * F.col("_l.l") / -F.col("_l.p")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = whitening.whiten(table, components=8)
    return out.withColumn("deviation", F.col("deviation").try_cast("bigint"))


# name -> (query, oracle SQL or None)
QUERIES = {
    "op1_warc": (op1_warc, SQL_OP1),
    "op2_jaccard_join": (op2_jaccard_join, None),
    "op3_ann": (op3_ann, None),
    "op4_language_id": (op4_language_id, None),
    "op5_line_dedup": (op5_line_dedup, SQL_OP5),
    "op6_token_counts": (op6_token_counts, None),
    "op7_decontaminate": (op7_decontaminate, SQL_OP7),
    "op8_byte_bpe": (op8_byte_bpe, None),
    "op9_lm_score": (op9_lm_score, None),
    "op10_quality": (op10_quality, None),
    "op11_personal_data": (op11_personal_data, None),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_whitening": (op13_whitening, None),
}
