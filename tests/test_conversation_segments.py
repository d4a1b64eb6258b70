"""Segments of conversations against the folded form, with a hot conversation, a hot message and nulls."""

import pytest
from pyspark.sql import functions as F

from quantiva.errors import ValidationError
from quantiva.operators import conversations


def _rows(spark):
    i = F.col("id")
    return spark.range(0, 3_000, 1, 5).select(
        F.when(i % 3 == 0, 7).when(i % 50 == 1, F.lit(None)).otherwise(i % 40).alias("conv_id"),
        F.when(i % 11 == 0, F.lit(None)).when(i % 6 == 0, 5).otherwise(i * 7919 % 1_000).alias("turn"),
        F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(i % 6 == 0, "again").when(i % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), i % 90)).alias("text"), i.alias("chunk"))


@pytest.mark.parametrize("size", [1, 7, 64, 5_000])
def test_segments_hold_what_a_fold_holds(spark, size):
    df = _rows(spark)
    whole = {r["conv_id"]: r["messages"] for r in conversations.conversation_fold(df).collect()}
    got = conversations.conversation_segments(df, size=size).collect()
    assert all(len(r["messages"]) == r["message_count"] <= size and r["first_position"] == r["chunk"] * size for r in got)
    for conv, messages in whole.items():
        own = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["chunk"])
        assert [r["chunk"] for r in own] == list(range(-(-len(messages) // size)))
        assert [m for r in own for m in r["messages"]] == messages
    assert len(got) == sum(-(-len(m) // size) for m in whole.values())


def test_segments_unfold_and_edges(spark):
    df = _rows(spark)
    back = conversations.segments_unfold(conversations.conversation_segments(df, size=10))
    want = conversations.conversation_unfold(conversations.conversation_fold(df))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, back.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert conversations.conversation_segments(df.limit(0)).collect() == []
    with pytest.raises(ValidationError):
        conversations.conversation_segments(df, size=0)
