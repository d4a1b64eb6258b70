"""Many columns: one-scan Pearson against pandas, and Spearman with ranks shared by null pattern."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantiva.operators import correlate, gram, ranks


def _table(rows=400, cols=36, seed=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(rows, cols)) @ r.normal(size=(cols, cols)) * 10.0 ** r.integers(-3, 6, cols) + r.normal(size=cols) * 100
    for c in range(0, cols, 3):
        x[r.random(rows) < 0.2, c] = np.nan
    x[:, 4] = 7.25                                   # constant
    x[:, 5] = 1e9 + r.normal(size=rows)              # hardly varies against its mean
    x[:, 6] = np.nan                                 # nothing
    x[: rows // 2, 7], x[rows // 2:, 8] = np.nan, np.nan   # never together
    x[~np.isnan(x[:, 9]), 10] = 3.5                  # constant where column 9 has values
    return pd.DataFrame(x, columns=[f"c.{i}" for i in range(cols)])


def _spark(spark, pdf, parts=5):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in pdf.columns)).repartition(parts)


def test_wide_pearson_equals_pandas(spark, monkeypatch):
    monkeypatch.setattr(gram, "GROUP", 2)
    monkeypatch.setattr(gram, "ROWS", 32)
    pdf = _table()
    scans = []
    plain = correlate._pearson_pairs
    monkeypatch.setattr(correlate, "_pearson_pairs", lambda d, e, p: scans.append(len(p)) or plain(d, e, p))
    got = {(r["column1"], r["column2"]): r for r in correlate.correlation(_spark(spark, pdf)).collect()}
    names = list(pdf.columns)
    assert len(got) == len(names) * (len(names) - 1) // 2 > correlate.PEARSON_PAIRS
    for (a, b), r in got.items():
        both = pdf[[a, b]].dropna()
        assert r["n"] == len(both)
        if len(both) == 0 or both[a].nunique() < 2 or both[b].nunique() < 2:
            assert r["correlation"] is None
        else:
            x, y = (both[c] - both[c].mean() for c in (a, b))
            x, y = x - x.mean(), y - y.mean()
            assert abs(r["correlation"] - (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())) < (1e-7 if "c.5" in (a, b) else 1e-9)
    assert len(scans) == 1 and scans[0] < 4 * len(names)  # only the columns that hardly vary


def test_wide_pearson_of_no_rows(spark):
    out = correlate.correlation(_spark(spark, _table()).limit(0)).collect()
    assert len(out) == 630 and all(r["n"] == 0 and r["correlation"] is None for r in out)


@pytest.mark.parametrize("small", [0, 10_000])
def test_spearman_ranks_once_for_each_null_pattern(spark, monkeypatch, small):
    monkeypatch.setattr(correlate, "SMALL_RANKS", small)
    r = np.random.default_rng(9)
    n = 240
    pdf = pd.DataFrame({"a": r.normal(size=n).round(1), "b": r.integers(0, 5, n).astype(float), "c": r.normal(size=n), "k": 2.0})
    gone, other = r.random(n) < 0.3, r.random(n) < 0.3
    for c, m in (("d", gone), ("e", gone), ("f", other), ("g", other), ("h", gone | other), ("i", np.ones(n, bool))):
        pdf[c] = np.where(m, np.nan, r.normal(size=n).round(1) + pdf["a"])
    ranked = []
    plain = ranks.average_ranks
    monkeypatch.setattr(ranks, "average_ranks", lambda vc, keys, **kw: ranked.append(keys) or plain(vc, keys, **kw))
    got = {(x["column1"], x["column2"]): x for x in correlate.correlation(_spark(spark, pdf), method="spearman").collect()}
    assert len(got) == 45
    for (a, b), x in got.items():
        both = pdf[[a, b]].dropna()
        assert x["n"] == len(both)
        if len(both) == 0 or both[a].nunique() < 2 or both[b].nunique() < 2:
            assert x["correlation"] is None
        else:
            assert abs(x["correlation"] - both[a].rank().corr(both[b].rank())) < 1e-9
    # one ranking of all complete columns, one for each shared pattern, none for each pair
    assert len(ranked) <= 7


def test_null_patterns_are_classes_of_rows(spark):
    df = spark.range(60).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).cast("double").alias("b"),
                                F.when(F.col("id") % 2 == 0, -F.col("id")).cast("double").alias("c"),
                                F.when(F.col("id") % 2 == 1, F.col("id")).cast("double").alias("d"), (-F.col("id")).cast("double").alias("e"))
    names = ["a", "b", "c", "d", "e"]
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1:]]
    patterns, alone = correlate._null_patterns(df, names, pairs)
    assert {k: sorted(v[1]) for k, v in patterns.items()} == {
        ("b",): [("a", "b"), ("a", "c"), ("b", "c"), ("b", "e"), ("c", "e")], ("d",): [("a", "d"), ("d", "e")], ("b", "d"): [("b", "d"), ("c", "d")]}
    assert alone == [("a", "e")]
