"""Conversation tables (S10, Q14, Q15): fold/unfold message lists, counts, topic tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.columns import check_columns, col
from .ranks import positions

# Topic tags and the lower-case substrings that select them
# (substring match: "test" also hits "latest").
TOPIC_RULES = [
    ("descriptive_statistics", ["mean", "average", "median", "std", "statistics"]),
    ("correlation_analysis", ["correlation", "relationship"]),
    ("outlier_detection", ["outlier", "anomaly"]),
    ("distribution_analysis", ["distribution", "normal"]),
    ("hypothesis_testing", ["test", "hypothesis"]),
]
DEFAULT_TOPIC = "general_inquiry"


def topics_expr(text) -> F.Column:
    low = F.lower(text)
    tags = []
    for tag, words in TOPIC_RULES:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        tags.append(F.when(hit, F.lit(tag)))
    arr = F.array_compact(F.array(*tags))
    return F.when(F.size(arr) > 0, arr).otherwise(F.array(F.lit(DEFAULT_TOPIC)))


def query_topics(df: DataFrame, text: str = "text") -> DataFrame:
    """Q14: input rows plus ``topics`` (array of tags, default general_inquiry)."""
    check_columns(df, [text])
    return df.withColumn("topics", topics_expr(col(text)))


def conversation_fold(df: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """S10 write side: conv_id, messages array<struct<turn, role, text>> in turn order, message_count.

    One record per conversation is the sink format itself; messages of one
    conversation are gathered by a hash aggregate (partial per task).
    """
    check_columns(df, [key, order, "role", "text"])
    g = df.groupBy(col(key).alias(key)).agg(
        F.array_sort(F.collect_list(F.struct(col(order).alias("turn"), col("role"), col("text")))).alias("messages"),
        F.count(F.lit(1)).cast("long").alias("message_count"),
    )
    return g


def conversation_unfold(folded: DataFrame, key: str = "conv_id") -> DataFrame:
    """S10 read side: one row per message (conv_id, position, turn, role, text)."""
    return folded.select(col(key), F.posexplode("messages").alias("position", "m")).select(
        key, "position", "m.turn", "m.role", "m.text")


def conversation_segments(df: DataFrame, key: str = "conv_id", order: str = "turn", size: int = 1000) -> DataFrame:
    """S10 for conversations of any length: conv_id, chunk, first_position, message_count, messages; one row
    for each ``size`` consecutive messages of a conversation, in the order of ``conversation_fold``.

    Distinct messages are counted, sorted into range partitions (a conversation may span many of them) and
    numbered by the offsets of (partition, conversation); a message that is repeated is dealt over its chunks by
    its range of positions.  So no task holds more than a chunk, however long a conversation or often a message is.
    A null key is a conversation of its own; null turns come first; an empty table has no segments.
    """
    check_columns(df, [key, order, "role", "text"])
    if size < 1:
        raise ValidationError("size must be at least 1")
    counts = df.select(F.struct(col(key).alias("key")).alias("k"),  # a struct of null equals itself in joins
                       F.struct(col(order).alias("turn"), col("role"), col("text")).alias("m")).groupBy("k", "m").agg(
        F.count(F.lit(1)).alias("cnt"))
    placed = positions(counts, ["k"], "m")
    last = F.col("below") + F.col("cnt")
    pieces = placed.select("k", "m", "below", last.alias("last"), F.explode(F.expr(
        f"sequence(below div {int(size)}L, (below + cnt - 1) div {int(size)}L)")).alias("chunk"))
    start = F.greatest("below", F.col("chunk") * size)
    end = F.least("last", (F.col("chunk") + 1) * size)
    parts = pieces.select("k", "chunk", F.struct(start.alias("at"), (end - start).cast("int").alias("times"), "m").alias("p"))
    return parts.groupBy("k", "chunk").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.sum("p.times").alias("message_count")).select(
        F.col("k.key").alias(key), "chunk", (F.col("chunk") * size).alias("first_position"), "message_count",
        F.flatten(F.transform("ps", lambda p: F.array_repeat(p["m"], p["times"]))).alias("messages"))


def segments_unfold(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows of ``conversation_segments`` as one row per message (conv_id, position, turn, role, text), by a scan alone."""
    return segments.select(col(key), "first_position", F.posexplode("messages").alias("i", "m")).select(
        key, (F.col("first_position") + F.col("i")).alias("position"), "m.turn", "m.role", "m.text")


def conversation_counts(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Q15: conv_id, role, n messages."""
    check_columns(df, [key, "role"])
    return df.groupBy(col(key).alias(key), col("role")).agg(F.count(F.lit(1)).cast("long").alias("n"))
