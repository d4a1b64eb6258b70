import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantiva.llm import ann_partitions, language_id, lm_interpolation, quality_cnn
from quantiva.llm.words import Hasher, blank_separators, ngrams
from tests.llm.helpers import prose, words

SF = "/root/testdata/sf0.01"


def test_word_hashes_follow_the_words(monkeypatch):
    from quantiva.llm import words as module

    texts = ["", "a", " a  b\tc\n", "A b C", "x" * 300, "é É漢 字", "ab", "a b", "b a", prose(1, 500), "z" * 90 + " " + "q" * 80]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    seen = {}
    for size in (64, 1 << 20):
        monkeypatch.setattr(module, "SEGMENT", size)
        for a, b, bounds, h in Hasher(blank_separators()).words(np.frombuffer(b"".join(raw), np.uint8), offsets):
            for k in range(a, b):
                own = h[bounds[k - a]:bounds[k - a + 1]].tolist()
                assert len(own) == len(words(texts[k]))
                for w, x in zip(words(texts[k]), own):
                    assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    h = np.array([1, 2, 3, 1, 2], np.uint64)
    assert len(ngrams(h, 2)) == 4 and ngrams(h, 2)[0] == ngrams(h, 2)[3] != ngrams(h[::-1], 2)[0]


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10**6 + i, t, lang, "s", 1) for i, (t, lang) in enumerate(
        [(None, "en"), ("", None), ("123 !!", "fr"), ("Привет мир это русский текст без единой знакомой буквы " * 5, None), ("a", None), ("the", None)])]
    table = docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("score", F.lit("clash"))
    out = language_id.identify(table)
    assert out.columns == docs.columns + ["lang_pred", "score", "cross_entropy", "rejected", "held_out"]
    rows = {r["doc_id"]: r for r in out.collect()}
    tested = [r for r in rows.values() if r["held_out"] and r["doc_id"] < 10**6]
    assert len(tested) > 150 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows.values())
    assert np.mean([r["lang"] == r["lang_pred"] for r in tested]) >= 0.99
    assert np.mean([r["rejected"] for r in tested]) <= 0.005
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert [(rows[10**6 + i]["lang_pred"], rows[10**6 + i]["rejected"]) for i in range(3)] == [("und", True)] * 3
    assert rows[10**6 + 3]["rejected"] and rows[10**6 + 3]["lang_pred"] in ("de", "en", "es", "fr")
    assert rows[10**6 + 5]["lang_pred"] == "en"
    assert language_id.identify(docs.limit(0)).collect() == []
    none = language_id.identify(docs.limit(3).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in none] == [("und", 0.0, True)] * 3


def test_kneser_ney_models_are_distributions():
    letters = language_id.letter_table()
    model = language_id.Model({"x": ["abc abd abc cab", "bad cab dab"], "y": ["xyz zyx abx"]}, letters)
    alphabet = sorted({ord(c) for c in "abcdxyz "})
    for a, b in ((1, 32), (32, ord("a")), (ord("a"), ord("b")), (ord("q"), ord("z"))):
        cols = [np.full(len(alphabet), v, np.uint64) for v in (a, b)] + [np.array(alphabet, np.uint64)]
        total = np.exp(model._logp(cols).astype(float)).sum(axis=0)
        # the rest of the mass belongs to symbols that no text has
        assert (total < 1 + 1e-5).all() and (total > 0.5).all()


def test_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "null id"), (10**6 + 2, "ab"), (10**6 + 3, "word " * 60000), (5, "again")], docs.schema)
    out = quality_cnn.score(docs.union(odd).withColumn("label", F.lit(1)), labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == docs.count() + 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[10**6]["score"] == by[10**6 + 1]["score"]
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    tested = [(truth[d], r["predicted"], r["score"]) for d, r in by.items() if r["held_out"] and d in truth and d != 5]
    good = [p for q, p, _ in tested if q == 1]
    assert np.mean(good) >= 0.97
    a, b = [s for q, _, s in tested if q == 1], [s for q, _, s in tested if q == 0]
    assert np.mean([[x > y for x in a] for y in b]) >= 0.85
    assert quality_cnn.score(docs.limit(0), labels).collect() == []
    one = quality_cnn.score(docs.limit(2), labels.filter("quality = 1")).collect()
    assert [r["predicted"] for r in one] == [1, 1]
    assert {r["score"] for r in quality_cnn.score(docs.limit(2), labels.limit(0)).collect()} == {0.5}


def test_scorer_reads_every_byte():
    net = quality_cnn.Network(seed=1)
    net.weights = np.random.default_rng(0).normal(size=net.weights.shape)
    scorer = quality_cnn.Scorer(net)
    raw = np.random.default_rng(1).integers(97, 100, 5001).astype(np.uint8)
    t = net.tables()
    n = -(-(len(raw) - quality_cnn.WIDTH) // quality_cnn.STEP) + 1
    x = np.zeros((n - 1) * quality_cnn.STEP + quality_cnn.WIDTH, np.uint8)
    x[: len(raw)] = raw
    out = np.stack([sum(t[j][x[p * quality_cnn.STEP + j]] for j in range(quality_cnn.WIDTH)) for p in range(n)])
    hops = [out[a:a + 32].max(axis=0) for a in range(0, n, 32)]
    chunks = np.tanh([np.maximum(a, b) for a, b in zip(hops, hops[1:])])
    z = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])
    want = 1 / (1 + np.exp(-(z @ net.weights + net.offset)))
    assert scorer.scores(raw, np.array([0, len(raw)]))[0] == pytest.approx(want, abs=1e-5)


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_interpolation, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(lm_interpolation, "TOKENS_A_SHARD", 20_000)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(10**6, None), (10**6 + 1, ""), (None, "the null id"), (10**6 + 2, "neverseenword"), (3, "again and again " * 3000), docs[0]]
    table = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id bigint, text string, block string, score double").repartition(3)
    rows = lm_interpolation.score(table).collect()
    crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode())
    count = collections.Counter()
    for d, t in docs:
        if crc(d) % 5 != 1:
            count.update(words(t) + [None])
    n, v = sum(count.values()), len(count)

    def base(t):
        return sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t) + [None])

    want = sorted(((d, crc(d) % 5 == 1, len(words(t)) + 1, sum(count[w] > 0 for w in words(t) + [None]), n, round(base(t), 6)) for d, t in docs), key=repr)
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in want], rel=1e-6)
    assert all(r["score"] < 0 for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)  # the model beats the base on held-out texts
    assert lm_interpolation.score(table.limit(0)).collect() == []
    assert lm_interpolation.score(table.filter("doc_id = -1 or doc_id = 1000000")).collect()[0]["n_tokens"] == 1


def test_lm_model_is_the_stated_mixture(spark, monkeypatch):
    """Scores recomputed from plain counts with the weights that the operator learned."""
    seen = {}
    learn = lm_interpolation.learn_weights
    monkeypatch.setattr(lm_interpolation, "learn_weights", lambda *a: seen.setdefault("w", learn(*a)))
    docs = [(i, prose(i, 30, 25)) for i in range(300)]
    rows = lm_interpolation.score(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    w = seen["w"]
    assert w == pytest.approx(np.clip(w, 0, 1)) and w.sum(axis=1) == pytest.approx(np.ones(len(w)))
    one, two = collections.Counter(), collections.Counter()
    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            s = ["<"] + words(t) + [None]
            one.update(s)
            two.update(zip(s, s[1:]))
    n, v = sum(one.values()) - one["<"], len(one) - 1
    for r in rows[:50]:
        s = ["<"] + words(docs[r["doc_id"]][1]) + [None]
        total = 0.0
        for h, x in zip(s, s[1:]):
            l2, l1, l0 = w[min(one[h].bit_length(), lm_interpolation.BUCKETS - 1)]
            total += math.log10(l2 * (two[h, x] / one[h] if one[h] else 0) + l1 * one[x] / n + l0 / (v + 1))
        assert r["score"] == pytest.approx(total, rel=1e-9)


def brute_neighbours(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        v = x[np.flatnonzero(ids == q)[0]]
        s = (x * v).sum(axis=1)
        keep = ids != q
        best = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = (ids[keep][best].tolist(), s[keep][best].tolist())
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann_partitions, "ROWS_A_PART", 100)
    monkeypatch.setattr(ann_partitions, "BLOCK_ROWS", 200)
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16)) * 2
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + r.normal(size=16)]) for i in range(1500)]
    hot = [0.5] * 16
    rows += [(2000 + i, hot) for i in range(500)]                            # a third of one part: equal vectors, ties by id
    rows += [(3000, None), (3001, []), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [float("inf")] + [0.0] * 15),
             (3080, [None] + [1.0] * 15), (None, hot), (3100, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, part int").repartition(3)
    got = {}
    for x in ann_partitions.search(table, F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    want = brute_neighbours([x for x in rows if x[1] is None or len(x[1]) != 2], 20)
    assert sorted(got) == sorted(want)
    recall = []
    for q, found in got.items():
        found.sort()
        assert [x for x, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        recall.append(len({i for _, i, _ in found} & set(want[q][0])) / 20)
    assert np.mean(recall) >= 0.9
    few = ann_partitions.search(table.filter("vec_id < 5"), F.col("id") % 20 == 0, k=20).collect()
    assert len(few) == 4 and ann_partitions.search(table.limit(0), F.col("id") % 20 == 0).collect() == []


def test_probes_are_enough_for_queries_the_router_has_not_seen(spark, monkeypatch):
    monkeypatch.setattr(ann_partitions, "ROWS_A_PART", 100)
    x = np.random.default_rng(6).normal(size=(6000, 96))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    found = ann_partitions.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 20 == 0).collect()
    want = brute_neighbours(rows, 20)
    assert sum(r["vec_id"] in want[r["query_id"]][0] for r in found) / 20 / len(want) >= 0.955


def test_queries_of_small_parts_and_repeated_ids_get_k_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann_partitions, "ROWS_A_PART", 64)
    monkeypatch.setattr(ann_partitions, "TARGET", 0.0)  # one part a query
    r = np.random.default_rng(3)
    common = r.normal(size=(600, 8)) * 0.01 + 3  # nearly all rows lie together
    rows = [(i, v) for i, v in enumerate(common.tolist())] + [(700, v) for v in common[:300].tolist()] + \
        [(10**4 + i, v) for i, v in enumerate((r.normal(size=(40, 8)) - 6).tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = {}
    for x in ann_partitions.search(table, F.col("id") % 20 == 0, k=50).collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    assert sorted(got) == sorted({i for i, _ in rows if i % 20 == 0})
    assert all(len(v) == 50 and q not in v for q, v in got.items())


def test_sample_is_the_lowest_hashes_of_distinct_rows(spark):
    from quantiva.llm.common import lowest

    rows = spark.range(20000).union(spark.range(5000).select(F.lit(1).cast("bigint"))).select(F.xxhash64("id").alias("h"))
    kept = {r["h"] for r in rows.filter(lowest(F.col("h"), F.lit(20000), 300)).collect()}
    every = sorted({r["h"] for r in rows.collect()})
    assert every[:len(kept)] == sorted(kept) and 500 <= len(kept) <= 700
    assert rows.filter(lowest(F.col("h"), F.lit(500), 300)).count() == rows.count()


def test_long_texts_are_scored_in_slices(monkeypatch):
    letters = language_id.letter_table()
    model = language_id.Model({"x": ["abc abd abc cab", "bad cab dab"], "y": ["xyz zyx abx"]}, letters)
    r = random.Random(4)
    for text in ["", " ", "  12 ", "Abc", "\x01a\x01", "é漢 \U0001d400b", "".join(r.choice("aBcx  1é\x01") for _ in range(997))]:
        sym, n_letters = language_id.symbols([text], letters)
        want = model.entropies([text], letters)
        for size in (1, 2, 3, 10, 997, 5000):
            parts = list(language_id.symbol_slices(text, letters, size))
            assert np.concatenate([sym[:2]] + [p[2:] for p, _ in parts]).tolist() == sym.tolist()
            assert sum(x for _, x in parts) == n_letters[0]
            with monkeypatch.context() as m:
                m.setattr(language_id, "_SLICE", size)
                for a, b in zip(model.entropies([text], letters), want):
                    assert a == pytest.approx(b)


def brute_kneser_ney(texts, letters):
    """P(symbol | two before) recomputed from plain dictionaries."""
    tri = collections.Counter()
    for t in texts:
        s = ["^"] + list(re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "))
        for i in range(2, len(s)):
            tri[tuple(s[i - 2:i + 1])] += 1
    bi = collections.Counter(g[1:] for g in tri)
    uni = collections.Counter(g[1:] for g in bi)

    def discount(c):
        a, b = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        return a / (a + 2 * b) if a and b else 0.5

    def p(g, tables, size):
        if not tables:
            return 1 / (size + 1)
        c, d = tables[0], discount(tables[0])
        own = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        lower = p(g[1:], tables[1:], size)
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * lower

    return lambda g, size: p(g, [tri, bi, uni], size), set(x[0] for x in uni)


def test_kneser_ney_from_plain_counts():
    letters = language_id.letter_table()
    texts = {"x": ["abc abd abc cab", "bad, cab 1 dab", "a"], "y": ["xyz zyx abx", "zz yx xyz"]}
    model = language_id.Model(texts, letters)
    brute = {k: brute_kneser_ney(v, letters) for k, v in texts.items()}
    size = len(brute["x"][1] | brute["y"][1])
    for a in "^ abxzq":
        for b in " abxzq":
            for c in " abcdxyzq":
                cols = [np.array([1 if v == "^" else ord(v)], np.uint64) for v in (a, b, c)]
                want = [math.log(brute[k][0]((a, b, c), size)) for k in ("x", "y")]
                assert model._logp(cols)[0] == pytest.approx(want, abs=1e-5), (a, b, c)


def test_lm_repeated_rows_are_dealt_over_blocks(spark, monkeypatch):
    docs = [(i, prose(i, 30, 25)) for i in range(60)] + [(7, "one row again and again " * 10)] * 400
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    whole = sorted(tuple(r) for r in lm_interpolation.score(table).collect())
    seen, keep = [], lm_interpolation.stored
    monkeypatch.setattr(lm_interpolation, "BLOCK_BYTES", 5_000)
    monkeypatch.setattr(lm_interpolation, "stored", lambda df, name: seen.append(name) or keep(df, name))
    dealt = sorted(tuple(r) for r in lm_interpolation.score(table).collect())
    assert "lm-rows" in seen and len(dealt) == len(whole)
    assert [x[:5] for x in dealt] == [x[:5] for x in whole]
    for a, b in zip(dealt, whole):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_short_texts_of_other_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang is not null and text is not null")
    test = language_id.held_out("doc_id", 4, 2)
    model, letters = language_id.fit(docs, train=~test)
    texts = [r["text"] for r in docs.filter(test).select("text").collect()]
    foreign = [
        "la casa era vicina al mare e ogni mattina i pescatori tornavano con le reti piene mentre i bambini giocavano sulla spiaggia",
        "talo oli lähellä merta ja joka aamu kalastajat palasivat verkot täynnä kun lapset leikkivät rannalla lämpimän auringon alla",
        "het huis stond dicht bij de zee en elke ochtend keerden de vissers terug met volle netten terwijl de kinderen buiten speelden",
        "dom stał blisko morza i każdego ranka rybacy wracali z pełnymi sieciami podczas gdy dzieci bawiły się na plaży pod słońcem",
        "ev denize yakındı ve her sabah balıkçılar dolu ağlarla dönerken çocuklar sıcak güneşin altında kumsalda oynuyorlardı"]

    def rejected(some):
        h, n, n_letters = model.entropies(some, letters)
        best = h.argmin(axis=1)
        return np.mean((h[np.arange(len(best)), best] > model.threshold(best, n))[n_letters > 0])

    rates = {}
    for size in (30, 60, 120):
        clean = [t[a:a + size] for t in texts for a in range(0, min(len(t), 3000) - size, 5 * size)]
        cut = [f[a:a + size] for f in foreign for a in range(0, len(f) - size + 1, 3)] or foreign
        rates[size] = rejected(clean), rejected(cut)
    print(rates, "whole", rejected(texts))
    assert all(c <= 0.003 for c, _ in rates.values()) and rejected(texts) <= 0.001, rates
    assert rates[60][1] >= 0.95 and rates[120][1] == 1, rates
