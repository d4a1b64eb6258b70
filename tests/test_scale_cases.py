"""Skew and streaming: a value holding a third of the rows, forced fine buckets, file-source ingest."""

import os
import tempfile

import pytest

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantiva.operators import ranks
from quantiva.streaming.ingest import start_ingest


def _skewed(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 40, n).astype(float)
    y = rng.normal(0, 1, n).round(2)
    x[: n // 3] = 7.0  # one hot value: a third of all rows
    y[n // 3: n // 2] = 0.5
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), x, y


def test_kendall_hot_value_fine_buckets(spark, monkeypatch):
    import quantiva.operators.kendall as K
    df, x, y = _skewed(spark)
    n = len(x)
    d = sum(1 for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
    c = sum(1 for i in range(n) for j in range(n) if x[i] < x[j] and y[i] < y[j])
    monkeypatch.setattr(K, "TARGET_POINTS", 10)
    r = K.kendall_pairs(df, [("x", "y")]).collect()[0]
    assert r["discordant"] == d and r["concordant"] == c


@pytest.mark.parametrize("rows", [1, 40, 100_000])
def test_quantiles_with_a_hot_value_and_narrowed_brackets(spark, monkeypatch, rows):
    monkeypatch.setattr(ranks, "ROWS_IN_BRACKET", rows)
    monkeypatch.setattr(ranks, "MARGIN", 0.2)
    monkeypatch.setattr(ranks, "ACCURACY", 50)
    df, _, _ = _skewed(spark, n=3000)
    probs = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.77, "e": 1.0}
    q = {r["cid"]: r for r in ranks.exact_quantiles(df, [F.col("x"), F.col("y")], probs).collect()}
    ref = df.agg(F.percentile("x", list(probs.values())), F.percentile("y", list(probs.values()))).collect()[0]
    for cid in (0, 1):
        assert [round(q[cid][k], 9) for k in "abcde"] == [round(v, 9) for v in ref[cid]]
    keyed = df.withColumn("g", F.pmod(F.xxhash64("y", "x"), F.lit(3)))
    q = {r["g"]: r for r in ranks.exact_quantiles(keyed, [F.col("x")], probs, keys={"g": F.col("g")}).collect()}
    for r in keyed.groupBy("g").agg(F.percentile("x", list(probs.values())).alias("p"), F.count("*").alias("n")).collect():
        assert [round(q[r["g"]][k], 9) for k in "abcde"] == [round(v, 9) for v in r["p"]] and q[r["g"]]["n"] == r["n"]


def test_quartiles_shuffle_only_rows_inside_the_brackets(spark):
    df = spark.range(200_000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("x"))
    out = ranks.exact_quantiles(df, [F.col("x")], {"q1": 0.25, "q3": 0.75})
    out.collect()
    read = 0
    plan = out._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    stack = [plan]
    while stack:  # rows that the value count reads from the scan, after the bracket filter
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
            continue
        if node.nodeName() == "Exchange":
            read = max(read, node.metrics().get("shuffleRecordsWritten").get().value())
        stack += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < read < 2_000


def test_positions_over_many_partitions(spark):
    df = spark.range(60_000).select((F.xxhash64("id") % 20_011).cast("double").alias("v"), (F.col("id") % 3).alias("k"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        vc = ranks.value_counts(df, ["k"], "v")
        pos = ranks.positions(vc.repartition(64), ["k"], "v").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    seen = {}
    for r in sorted(pos, key=lambda r: (r["k"], r["v"])):
        assert r["below"] == seen.get(r["k"], 0) and r["n"] == 20_000
        seen[r["k"]] = r["below"] + r["cnt"]
    assert set(seen.values()) == {20_000}


def test_average_ranks_match_rank_window(spark):
    df, _, _ = _skewed(spark, n=500)
    vc = ranks.value_counts(ranks.long_values(df, [F.col("x")]), ["cid"])
    got = {r["value"]: r["rank"] for r in ranks.average_ranks(vc, ["cid"]).collect()}
    from pyspark.sql import Window
    w = Window.orderBy("x")  # fine on a 500-row fixture
    ref = df.select("x", (F.rank().over(w) + (F.count("*").over(Window.partitionBy("x")) - 1) / 2.0).alias("r")).distinct()
    for r in ref.collect():
        assert abs(got[r["x"]] - r["r"]) < 1e-9


def test_streaming_ingest_once(spark):
    src = tempfile.mkdtemp(prefix="qv-stream-src-")
    out = tempfile.mkdtemp(prefix="qv-stream-out-")
    ck = tempfile.mkdtemp(prefix="qv-stream-ck-")
    for name, rows in [("a.csv", ["1,10", "2,N/A"]), ("b.csv", ["3,30"])]:
        with open(os.path.join(src, name), "w") as f:
            f.write("id,v\n" + "\n".join(rows) + "\n")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.StringType())])
    q = start_ingest(spark, src, schema, os.path.join(out, "t"), ck, numeric=["v"], once=True)
    q.awaitTermination(120)
    got = {r["id"]: r for r in spark.read.parquet(os.path.join(out, "t")).collect()}
    assert got["1"]["v"] == 10.0 and got["2"]["v"] is None and got["3"]["__source_file__"] == "b.csv"


def test_value_counts_global_rank_matches_window(spark):
    from quantiva.operators import categorical
    df = spark.read.parquet("/root/testdata/sf0.001/part.parquet").repartition(5)
    got = {(r["column"], r["value"]): r["rank"] for r in categorical.value_counts(df, ["p_name", "p_brand"]).collect()}
    top = {(r["column"], r["value"]): r["rank"] for r in categorical.value_counts(df, ["p_name", "p_brand"], top=10**6).collect()}
    assert got == top and sorted(v for k, v in got.items() if k[0] == "p_brand") == list(range(1, 1 + sum(1 for k in got if k[0] == "p_brand")))


def test_normality_of_repeated_and_constant_columns(spark):
    from quantiva.operators.normality import normality
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_partkey", "l_discount", F.lit(1.0).alias("one"),
                                                                              F.monotonically_increasing_id().alias("id"))
    for key in (None, ["id"]):
        r = {x["column"]: x for x in normality(df, ["l_discount", "one"], key=key).collect()}
        assert r["l_discount"]["sample_size_used"] == 5000 and 0 < r["l_discount"]["statistic"] < 1 and r["l_discount"]["p_value"] < 0.05
        assert r["one"]["sample_size_used"] == 5000 and r["one"]["statistic"] is None
    assert normality(df.select("l_discount")).collect()[0]["statistic"] is not None
    with pytest.raises(Exception, match="does not identify rows"):
        normality(df, ["l_discount"], key=["one"]).collect()
    grouped = normality(df.withColumn("g", F.col("id") % 2), ["l_discount"], by="g", max_n=500, key=["id"]).collect()
    assert {x["g"] for x in grouped} == {"0", "1"} and all(x["sample_size_used"] == 500 for x in grouped)


def test_pearson_in_blocks_of_pairs(spark, monkeypatch):
    from quantiva.operators import correlate
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("l_tax", F.when(F.col("l_orderkey") % 9 > 0, F.col("l_tax")))
    cols = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    whole = {(r[0], r[1]): r[2:4] for r in correlate.correlation(df, cols).collect()}
    monkeypatch.setattr(correlate, "PEARSON_PAIRS", 3)
    assert {(r[0], r[1]): r[2:4] for r in correlate.correlation(df, cols).collect()} == whole


def test_worklist_of_mixed_columns(spark, monkeypatch):
    """Eleven values beside a near-unique column: the one leaves the list, the other is narrowed on; the last
    window never sorts more distinct values of a bracket than allowed."""
    monkeypatch.setattr(ranks, "ROWS_IN_BRACKET", 300)
    monkeypatch.setattr(ranks, "MARGIN", 0.05)
    df = spark.range(60_000).select((F.col("id") % 11).cast("double").alias("few"), (F.xxhash64("id") % 1_000_003).cast("double").alias("many"),
                                    F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.xxhash64("id") % 1_000_003).cast("double").alias("hot"))
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    passes, sorted_values = [], []
    narrow, counted = ranks._Selection.narrow, ranks._Selection._counted

    def seen(self):
        passes.append([self.cells[x][0] for x in self.active])
        narrow(self)

    def last(self):
        for x in self.open:
            sorted_values.append(self.base.where(self.inside(x)).select(self.value(x)).distinct().count())
        return counted(self)

    monkeypatch.setattr(ranks._Selection, "narrow", seen)
    monkeypatch.setattr(ranks._Selection, "_counted", last)
    got = {r["cid"]: r for r in ranks.exact_quantiles(df, [F.col(c) for c in df.columns], probs).collect()}
    ref = df.agg(*[F.percentile(c, list(probs.values())) for c in df.columns]).collect()[0]
    assert [[got[i][k] for k in probs] for i in range(3)] == [list(r) for r in ref]
    assert passes and all(0 not in p for p in passes) and 1 in passes[0]
    assert sorted_values and max(sorted_values) <= 300


def test_modes_equal_grouping(spark, monkeypatch):
    n = 20_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("leads"), F.col("id").cast("double").alias("distinct"),
        (F.col("id") % 10).cast("double").alias("ties"), F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") < 4, -1.5).otherwise(F.col("id").cast("double")).alias("barely"), F.lit(2.5).alias("same"))
    values = [F.col(c) for c in df.columns]

    def run():
        row = df.agg(*ranks.heavy_aggs(values), *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)]).collect()[0]
        heavy, counts = [row[f"_t{i}"] for i in range(len(values))], [row[f"n{i}"] for i in range(len(values))]
        return {r["cid"]: r["mode"] for r in ranks.modes(df, values, heavy, counts).collect()}

    grouped = []
    plain = ranks.value_counts
    monkeypatch.setattr(ranks, "value_counts", lambda d, k: grouped.extend(
        sorted(r["cid"] for r in d.select("cid").distinct().collect())) or plain(d, k))
    assert run() == {0: 7.0, 1: 0.0, 2: 0.0, 4: -1.5, 5: 2.5}
    assert set(grouped) <= {1, 4}  # where one value leads nothing is shuffled by value
    monkeypatch.setattr(ranks, "TRACKED", 12)
    monkeypatch.setattr(ranks, "TOP", 3)
    assert run() == {0: 7.0, 1: 0.0, 2: 0.0, 4: -1.5, 5: 2.5}
