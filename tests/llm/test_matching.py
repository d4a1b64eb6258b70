import random

from quantiva.llm import components, decontaminate, jaccard_join
from tests.llm.helpers import ALNUM, edited, jaccard_components, prose, words


def brute_passages(docs, items, window=10, least=1):
    runs = {}
    for i, t in items:
        if i is None or t is None:
            continue
        w = words(t, ALNUM)
        if len(w) < max(least, 1):
            continue
        size = min(window, len(w))
        for a in range(len(w) - size + 1):
            runs.setdefault(tuple(w[a:a + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w = words(t, ALNUM)
        hit, found = set(), set()
        for size in {len(r) for r in runs}:
            for a in range(len(w) - size + 1):
                own = runs.get(tuple(w[a:a + size]))
                if own:
                    hit.update(range(a, a + size))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def test_passages_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    items = [(i, prose(100 + i, r.choice([1, 2, 3, 5, 9, 10, 11, 25]), 30)) for i in range(25)]
    items += [(3, prose(999, 14, 30)), (50, None), (None, "w1 w2 w3"), (51, " ... "), (52, "the the the the the the the the the the the the"),
              (53, "ÉCOLE é" + " mot" * 12), (54, items[7][1])]
    docs = [(i, prose(i, r.randrange(1, 80), 30)) for i in range(60)]
    docs += [(100, items[7][1].upper()), (101, prose(1, 20, 30) + ", " + items[10][1] + "!"), (102, "the " * 400), (103, None), (104, ""),
             (None, items[0][1]), (100, items[7][1].upper()), (105, "École É " + "MOT " * 12), (106, prose(8, 30000, 30)), (107, "w1")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    table = spark.createDataFrame([(d, t, 7, "c") for d, t in docs], "doc_id bigint, text string, n_hit int, c0 string").repartition(3)
    for blocks, least in ((1 << 20, 1), (700, 1), (1 << 20, 10)):  # one block, several blocks, no short items
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", blocks)
        out = decontaminate.find_passages(table, bench, min_item_words=least)
        assert out.columns == ["doc_id", "text", "c0", "n_words", "n_hit", "spans", "items"]
        rows = out.collect()
        assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], list(x["items"])) for x in rows), key=repr) == brute_passages(docs, items, least=least)
        for x in rows:
            assert sum(s["end"] - s["start"] for s in x["spans"]) == x["n_hit"]
    assert decontaminate.find_passages(table.limit(0), bench).collect() == []
    assert all(x["n_hit"] == 0 for x in decontaminate.find_passages(table, bench.limit(0), columns=["doc_id"]).collect())


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(-5, 7), (9, 9)]
    links += [(5000, 5001 + i) for i in range(200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def cluster_documents():
    """Chains and clouds of near copies around the threshold, shared passages, copies, short and empty texts."""
    docs = []
    base = [prose(1000 + k, 60 + 15 * k) for k in range(6)]
    for k, b in enumerate(base):
        docs += [b] * 2
        docs += [edited(b, 50 * k + j, 0.002 * j) for j in range(14)]
        chain = b
        for j in range(5):
            chain = edited(chain, 900 + 10 * k + j, 0.02)
            docs.append(chain)
        docs.append(b + " " + prose(k, 5))
    common = prose(77, 12)
    docs += [common + " " + prose(2000 + j, 10 + j) for j in range(40)]      # a passage that many share
    docs += [common + " " + common.upper() + f" t{j}" for j in range(30)]
    docs += ["", None, "  \n\t", "one", "one", "ONE", "one two", "two one", "one two three", "One  two\nthree", "a a a a a a a a", "a a a a"]
    docs += [prose(5, 6000), edited(prose(5, 6000), 1, 0.005)]
    return docs


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    texts = cluster_documents()
    r = random.Random(9)
    ids = r.sample(range(10 * len(texts)), len(texts))
    docs = list(zip(ids, texts)) + [(None, texts[0]), (None, "nothing else has these words at all"), (ids[3], texts[3]), (ids[5], texts[40])]
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, c string, n_shingles int").repartition(4)
    for n, percent in ((3, 90), (5, 80)):
        want = jaccard_components(docs, n, percent)
        got = jaccard_join.near_duplicates(table, n, percent).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got), key=repr) == sorted(
            ((d, k, c) for (d, _), (k, c) in zip(docs, want)), key=repr)


def test_keep_one_and_empty_table(spark):
    a, b = prose(1, 50), prose(2, 50)
    docs = [(4, a), (2, a + " tail"), (9, b), (9, b), (None, a), (None, "null id only"), (7, ""), (8, None), (None, prose(3, 40)), (None, prose(3, 40) + " x")]
    table = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(docs)], "doc_id bigint, text string, row_key int")
    kept = jaccard_join.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(((x["doc_id"], (x["text"] or "")[:12]) for x in kept.collect()), key=repr) == sorted(
        [(2, (a + " tail")[:12]), (9, b[:12]), (None, "null id only"), (7, ""), (8, ""), (None, prose(3, 40)[:12])], key=repr)
    assert jaccard_join.near_duplicates(table.limit(0)).collect() == []
