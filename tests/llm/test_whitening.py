import numpy as np
import pytest
from pyspark.sql import functions as F

from quantiva.llm import queries, whitening

SF = "/root/testdata/sf0.01"


def plain(vectors):
    """n, sums, eigenvalues and eigenvectors by numpy, exact deviations by Python integers."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = np.array(x, float) - np.array([s / n for s in sums])
    e, v = np.linalg.eigh(y.T @ y / n)
    dev = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return n, y, e[::-1], v[:, ::-1], dev


def compare(rows, ids, vectors, most=8):
    n, y, e, v, dev = plain(vectors)
    want = dict(zip(ids, range(len(ids))))
    got = {(r["vec_id"], r["component"]): r for r in rows}
    rank = int((e > 1e-9 * max(e[0], 1e-300)).sum())
    k = min(most, rank)
    assert len(rows) == len(got) == n * k
    sign = {}
    for (i, c), r in got.items():
        row = want[i]
        assert r["n"] == n and r["deviation"] == dev[row]
        assert abs(r["explained"] / (e[c - 1] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
        w = y[row] @ v[:, c - 1] / np.sqrt(e[c - 1])
        if abs(w) > 1e-6:
            assert sign.setdefault(c, np.sign(w * r["whitened"])) == np.sign(w * r["whitened"])
        assert abs(abs(w) - abs(r["whitened"])) < 1e-7 * max(1, abs(w))


def test_query_equals_numpy(spark):
    out = queries.op13_whitening(spark, SF)
    assert [(c, k) for c, k in out.dtypes] == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
        ("explained", "double"), ("identity_error", "double")]
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    compare(out.collect(), [r["vec_id"] for r in table], [r["embedding"] for r in table])


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (5, 5), (9, 3), (40, 40), (64, 20)])
def test_factor_and_rotations(d, rank):
    r = np.random.default_rng(d)
    y = (r.normal(size=(200, rank)) * np.logspace(0, -4, rank)) @ r.normal(size=(rank, d))
    s = y.T @ y
    low, order = whitening.factor(s)
    assert low.shape[1] == rank and np.allclose(low @ low.T, s[order][:, order], atol=1e-12 * s.max())
    assert np.allclose(np.triu(low[:rank], 1), 0) and (np.diff(low.diagonal()) <= 1e-9 * low[0, 0]).all()
    e, v = whitening.principal(s)
    want = np.linalg.eigvalsh(s)[::-1][:rank]
    assert np.allclose(e, want, rtol=1e-6) and np.allclose(v.T @ v, np.eye(rank), atol=1e-7)
    assert np.allclose(v * e @ v.T, s, atol=1e-10 * s.max())


def test_rounds_meet_every_pair_once():
    for n in (2, 4, 10):
        seen = [tuple(sorted(p)) for a, b in whitening.rounds(n) for p in zip(a.tolist(), b.tolist())]
        assert len(seen) == len(set(seen)) == n * (n - 1) // 2


def test_deviations_are_exact_at_every_size():
    r = np.random.default_rng(1)
    for n, spread in ((50, 1000), (10 ** 9, 10 ** 6), (10 ** 12, 10 ** 4), (10 ** 14, 10 ** 9), (10 ** 9, 1 << 39)):
        x = r.integers(-spread, spread, (20, 6)) + 100_000
        sums = [int(v) for v in r.integers(0, spread, 6)]
        sums = [s * n + int(r.integers(0, n)) for s in sums]
        got = whitening.Fit(n, sums).deviations(x).to_pylist()
        want = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
        assert [None if v is None else int(v) for v in got] == [v if v < 10 ** 38 else None for v in want]


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "GROUP", 2)
    monkeypatch.setattr(whitening, "BAND", 4)
    r = np.random.default_rng(2)
    good = [[float(c) for c in r.normal(size=3)] for _ in range(30)]
    good += [good[0]] * 10 + [[-0.0, 1e-9, 2.5]]
    rows = [(i, v, 0.5) for i, v in enumerate(good)]
    bad = [(100, None, 0.1), (101, [], 0.1), (102, [1.0, None, 2.0], 0.1), (103, [1.0, float("nan"), 2.0], 0.1),
           (104, [1.0, float("inf"), 2.0], 0.1)]
    schema = "vec_id bigint, embedding array<float>, whitened double"
    table = spark.createDataFrame(rows + bad, schema).repartition(9)
    exact = [[float(np.float32(c)) for c in v] for v in good]
    compare(whitening.whiten(table).collect(), list(range(len(good))), exact)
    compare(whitening.whiten(table, components=2).collect(), list(range(len(good))), exact, most=2)
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 0.0) for i in range(20)], schema)   # rank 1
    compare(whitening.whiten(flat).collect(), list(range(20)), [[float(i), 2.0 * i, 7.0] for i in range(20)])
    for empty in (table.limit(0), table.filter("vec_id >= 100"), table.filter("vec_id = 1"), table.filter("vec_id in (0, 30)")):
        out = whitening.whiten(empty)
        assert out.columns[0] == "vec_id" and out.dtypes == whitening.whiten(table).dtypes and out.collect() == []
    again = spark.createDataFrame([(None, v, 0.0) for v in good] + [(None, good[1], 0.0)], schema)
    assert whitening.whiten(again).count() == 3 * (len(good) + 1)
    doubles = table.withColumn("embedding", F.col("embedding").cast("array<double>"))
    compare(whitening.whiten(doubles).collect(), list(range(len(good))), exact)
    for wrong in ([1.0, 2.0], [1e30, 0.0, 0.0]):
        with pytest.raises(Exception, match="different numbers|too large"):
            whitening.whiten(spark.createDataFrame(rows + [(200, wrong, 0.0)], schema).coalesce(2)).collect()
