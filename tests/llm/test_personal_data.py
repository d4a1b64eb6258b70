import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantiva.llm import personal_data as pd11
from quantiva.llm import queries

SF = "/root/testdata/sf0.01"
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for at, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), at, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def found(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = pd11.find_spans(docs, **kw).collect()
    return {r["doc_id"]: [(s["kind"], s["value"], s["base"]) for s in r["spans"]] for r in rows}, rows


def test_query_equals_brute_force(spark):
    out = queries.op11_personal_data(spark, SF)
    assert [(c, k) for c, k in out.dtypes] == [("doc_id", "bigint"), *[(f"n_{k}", "bigint") for k in BASE], ("base_sha256", "string"),
                                               ("spans", "string")]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = base_spans(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s in set(want)] == want
        order = [(int(s.split(":")[1]), list(BASE).index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)
        for s in set(spans) - set(want):  # added ones: no digits of their number before or after, no overlap with base ones
            kind, a, b = s.split(":")[0], *map(int, s.split(":")[1:])
            assert not any(int(w.split(":")[1]) < b and int(w.split(":")[2]) > a for w in want)


CARD, CARD2 = "4650195898803591", "4994226020900891"


def corpus():
    r = np.random.default_rng(4)
    names = ["anna.b", "tom_77", "x-ray"]
    texts = []
    for i in range(400):
        n, bare = int(r.integers(1, 250)), i % 16 > 7
        texts.append([f"{'so' if bare else 'write to'} {names[i % 3]}{i}@mail{i % 7}.example.com please", f"host {n}.12.{i % 200}.4 is up",
                      f"{'and' if bare else 'card'} {CARD if i % 3 else CARD2} paid", f"{'then' if bare else 'call'} +1 ({200 + i}) 555-{1000 + i} now",
                      f"token a{i}f{n}4242424242424242{i}b end", f"order 1234567890123{i % 10}{n} of {i}",
                      f"plain words and {i} numbers {n}, 3.14 and 2020-01-{i % 28}", f"ratio 300.{i}.2.999 bad"][i % 8])
    return texts


def test_method_adds_what_base_matches_miss_and_nothing_else(spark):
    planted = {
        "both +1 (208) 555-1177 4284896609045836 here": [("phone", "+1 (208) 555-1177"), ("card", "4284896609045836")],
        f"twice {CARD} {CARD2} there": [("card", CARD), ("card", CARD2)],
        f"{CARD} 27.65.93.188": [("card", CARD)],
        "mail me: joe.doe [at] post [dot] example [dot] com thanks": [("email", "joe.doe [at] post [dot] example [dot] com")],
        "phone (415) 555-2671 today": [("phone", "(415) 555-2671")],
    }
    clean = ["see you at noon, dot com bubble at large", "version 1.2.3 of 2024-05-06", "4650195898803592 4650195898803593",
             "hash 4650195898803591a0", "10000000000000000000000000 and 12 34 56 78", "a @ b", "at [at] at"]
    texts = corpus() + list(planted) + clean
    got, _ = found(spark, texts)
    at = len(corpus())
    for k, want in enumerate(planted.values()):
        assert [(a, b) for a, b, base in got[at + k] if not base] == want
    for k in range(len(clean)):
        assert [x for x in got[at + len(planted) + k] if not x[2]] == []
    assert all(base for k in range(at) if k % 8 != 5 for _, _, base in got[k])  # an order number may pass as a card


def test_expectation_maximisation_and_newton_equal_plain_versions(spark):
    r = np.random.default_rng(8)
    rows = []
    for kind in (0, 2):
        for _ in range(40):
            votes = r.integers(-1, 2, len(pd11.LABELERS)).tolist()
            active = [0] + [1 + 2 * i + (v < 0) for i, v in enumerate(votes) if v] + [13 + int(r.integers(0, 5))]
            rows.append((kind, votes, active, int(r.integers(1, 60))))
    counted = spark.createDataFrame(rows, "kind int, votes array<int>, active array<int>, n bigint")
    model = pd11.fit_labelers(counted, steps=6)
    weights = pd11.fit_classifier(counted, model, steps=8)
    for kind in (0, 2):
        own = [(v, a, n) for k, v, a, n in rows if k == kind]
        n = np.array([x[2] for x in own], float)
        table = {y: np.tile(np.array(pd11.START[y]), (len(pd11.LABELERS), 1)) for y in (0, 1)}
        prior = 0.5
        for step in range(7):
            one, zero = prior * np.ones(len(own)), (1 - prior) * np.ones(len(own))
            for i in range(len(pd11.LABELERS)):
                one *= [table[1][i][v[i] + 1] for v, _, _ in own]
                zero *= [table[0][i][v[i] + 1] for v, _, _ in own]
            p = one / (one + zero)
            if step == 6:
                break
            mass = {1: (n * p).sum(), 0: (n * (1 - p)).sum()}
            prior = (mass[1] + pd11.PSEUDO) / (mass[0] + mass[1] + 2 * pd11.PSEUDO)
            for y, q in ((1, p), (0, 1 - p)):
                for i in range(len(pd11.LABELERS)):
                    for v in (-1, 0, 1):
                        hit = np.array([x[0][i] == v for x in own])
                        table[y][i][v + 1] = ((n * q)[hit].sum() + pd11.PSEUDO * pd11.START[y][v + 1]) / (mass[y] + pd11.PSEUDO)
        got = {tuple(x["votes"]): x["p"] for x in counted.filter(f"kind = {kind}").select(
            "votes", model.probability(F.col("kind"), F.col("votes")).alias("p")).collect()}
        assert np.allclose([got[tuple(v)] for v, _, _ in own], p, rtol=1e-9)
        x = np.zeros((len(own), pd11.FEATURES))
        for k, (_, active, _) in enumerate(own):
            x[k, active] = 1
        w = np.array(weights[kind])
        slope = x.T @ (n * (p - 1 / (1 + np.exp(-x @ w)))) - pd11.RIDGE * w
        assert np.abs(slope).max() < 1e-3  # the optimum of the penalised likelihood


@pytest.mark.parametrize("k", [0, 1, 2, 3, 10, 17])
def test_running_sums(spark, k):
    numbers = [(i * 7) % 5 for i in range(k)]
    got = spark.createDataFrame([(numbers,)], "x array<int>").select(pd11.running_sums(F.col("x")).alias("s")).collect()[0]["s"]
    assert got == [sum(numbers[:i]) for i in range(k)]


def test_awkward_rows(spark):
    texts = [None, "", "é漢😀 a@b.co é漢😀 1.2.3.4", "a@b.c_d@e.f, x@y", "1.2.3.4.5.6.7.8.9", "+1234 5678 (9) +1", "256.1.1.1 0255.000.1.2",
             CARD + " " + CARD, "4-6-5-0-1-9-5-8-9-8-8-0-3-5-9-1", "a" * 300_000, "1" * 300_000, "a@" + "b." * 100_000 + "c",
             "1-" * 200_000, "+" * 100_000, "a.b@c.de " * 1_000, "1." * 1_000, "+1" + "(" * 100_000]
    known = {"a" * 300_000: [], "1" * 300_000: [], "1-" * 200_000: [], "+" * 100_000: [], texts[11]: [f"email:0:{len(texts[11])}"]}  # plain regex matching takes too long on these
    docs = spark.createDataFrame([(None if i == 3 else 5, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, Spans int")
    out = pd11.find_spans(docs.unionAll(docs.filter("Spans = 2")))
    assert out.columns == ["doc_id", "text", "spans"]
    rows = out.collect()
    assert len(rows) == len(texts) + 1 and sum(r["doc_id"] is None for r in rows) == 1
    for r in rows:
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["base"]] == (
            known[r["text"]] if r["text"] in known else base_spans(r["text"]))
        assert all(r["text"][s["start"]:s["end"]] == s["value"] and 0 <= s["probability"] <= 1 for s in r["spans"])
    assert pd11.find_spans(docs.limit(0)).collect() == []
    assert [r["spans"] for r in pd11.find_spans(docs.filter("text is null or text = ''"), columns=["doc_id"]).collect()] == [[], []]
