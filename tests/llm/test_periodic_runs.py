import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantiva.llm import periodic_runs, queries

SF = "/root/testdata/sf0.01"


def brute_runs(w, least=12):
    """Every maximal stretch by plain comparison of each distance."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def laid(texts):
    ids, ends, top = [], [], 1 + max([x for t in texts for x in t], default=0)
    for k, t in enumerate(texts):
        ids += list(t)
        ends.append(len(ids))
        ids.append(top + k)
    return np.array(ids, np.int64), np.array(ends, np.int64)


def periodic(r, words, n):
    w = [r.randrange(words) for _ in range(n)]
    if n and r.random() < 0.7:
        a, p = r.randrange(n), 1 + r.randrange(max(1, n // 2))
        for i in range(a, r.randrange(a, n + 1)):
            w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("largest", [4, 1 << 12])
def test_runs_equal_brute_force(monkeypatch, largest):
    monkeypatch.setattr(periodic_runs, "LARGEST_BLOCK", largest)
    r = random.Random(largest)
    for _ in range(80):
        texts = [periodic(r, r.choice([1, 2, 2, 3, 5, 300]), r.choice([0, 1, 5, 11, 12, 13, 40, 120, 300])) for _ in range(r.randrange(1, 6))]
        ids, ends = laid(texts)
        base = np.concatenate([[0], ends[:-1] + 1]).tolist()
        want = [(b + s, b + s + n, q) for b, t in zip(base, texts) for s, n, q in brute_runs(t)]
        assert [tuple(x) for x in periodic_runs.find_runs(ids, ends).tolist()] == want


@pytest.mark.parametrize("n", [8, 64, 1024, 4096])
def test_squared_differences_are_exact(n):
    r = np.random.default_rng(n)
    values = r.integers(0, periodic_runs.PRIME, 6 * n).astype(float)
    c, first, places, at = n // 8, 3, n - n // 8 + 1, np.array([0, 5, n])
    got = periodic_runs.squared_differences(values, at, c, first, places)
    v = values.astype(object)
    for row, i in enumerate(at):
        for place in r.integers(0, places, 30):
            want = sum((v[i + k] - v[i + first + place + k]) ** 2 for k in range(c)) % periodic_runs.PRIME
            assert got[row, place] == want


def test_wrong_hashes_do_not_change_runs(monkeypatch):
    """With prefix hashes that find everything equal, the comparison word by word still decides."""
    monkeypatch.setattr(periodic_runs.Stretches, "_equal", lambda self, i, d, length: np.ones(len(i), bool))
    r = random.Random(3)
    for _ in range(40):
        w = periodic(r, 3, 80)
        ids, ends = laid([w])
        assert [(a, b - a, q) for a, b, q in periodic_runs.find_runs(ids, ends).tolist()] == brute_runs(w)


def expected(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_query_equals_brute_force(spark):
    out = queries.op12_periodic_runs(spark, SF)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert dict(out.dtypes)["exponent_milli"] == "bigint" and dict(out.dtypes)["n_runs"] == "bigint"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 9000}
    got = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert len(got) == len(docs) and {k: got[k] for k in want} == want
    assert sum(1 for x in want.values() if x[1]) > 50


def test_awkward_rows(spark, monkeypatch):
    long = "ab cd e f " * 200_000
    rows = [(1, None, 7), (2, "", 7), (3, " \t\n\x0b\x0c\r", 7), (4, "x " * 11, 7), (5, "x " * 12, 7), (None, "a b " * 6 + "c", 7),
            (6, "é é é é é é É é é é é é é", 7), (7, long, 7), (5, "x " * 12, 7), (8, "a\x00b " * 12, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Runs int")
    got = {(r["doc_id"], r["text"]): r for r in periodic_runs.find(docs).collect()}
    assert periodic_runs.find(docs).columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    plain = {k: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for k, r in got.items()}
    assert plain[(1, None)] == plain[(2, "")] == plain[(3, rows[2][1])] == (0, [], "")
    assert plain[(4, "x " * 11)] == (11, [], " ".join("x" * 11))
    assert plain[(5, "x " * 12)] == (12, [(0, 12, 1)], "x")
    assert plain[(None, "a b " * 6 + "c")] == (13, [(0, 12, 2)], "a b c")
    assert plain[(6, rows[6][1])] == (13, [], rows[6][1])
    assert plain[(7, long)] == (600_000, [(0, 600_000, 3)], "ab cd e f")
    assert plain[(8, rows[9][1])] == (12, [(0, 12, 1)], "a\x00b")
    assert len(periodic_runs.find(docs).collect()) == len(rows)
    assert periodic_runs.find(docs.limit(0)).collect() == []
    few = periodic_runs.find(docs.filter("doc_id = 5").repartition(1), columns=["doc_id"])
    assert few.columns == ["doc_id", "n_words", "runs", "collapsed"] and few.count() == 2
    with_gap = queries.with_periods(docs.withColumn("extra", F.lit(1))).collect()
    assert len(with_gap) == len(rows)
