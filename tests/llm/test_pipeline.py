import corpus_pipeline
import __spark_entry__ as entry
from quantiva.llm import queries
from tests.llm.helpers import ALNUM, edited, jaccard_components, prose, words

SF = "/root/testdata/sf0.01"


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == list(queries.QUERIES) and "pipeline" in names
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_stages_on_planted_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = [r["text"] for r in docs.filter("length(text) between 800 and 1500 and lang = 'en'").orderBy("doc_id").limit(30).collect()]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leak = next(r["text"] for r in bench.collect() if len(words(r["text"], ALNUM)) >= 30)
    flat = [" ".join(t.split()) for t in clean]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(flat)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "!!! 123", "en", "s", 7), (103, flat[0], "en", "s", 1),
             (104, edited(flat[1], 3, 0.01), "en", "s", 1), (105, flat[2] + " " + leak, "en", "s", 1), (106, clean[4] + "\n" + flat[5], "en", "s", 1),
             (107, "a\n" + clean[4], "en", "s", 1), (5, flat[5], "en", "s", 1)]
    table = spark.createDataFrame(rows, docs.schema)
    base = corpus_pipeline.STAGES
    kept = base[0][1](spark, table.union(docs.filter("doc_id > 200")), SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    ids = [r["doc_id"] for r in kept.filter("doc_id < 200").collect()]
    assert sorted(ids) == sorted(r[0] for r in rows if r[0] not in (100, 101, 102))
    table = table.filter("doc_id not in (100, 101, 102)")
    lines = {r["doc_id"]: r for r in base[1][1](spark, table, SF).collect()}
    if clean[4].count("\n") >= 2:
        assert lines[107]["text"] == "a" and lines[107]["n_chars"] == 1
    assert lines[106]["text"] == clean[4] + "\n" + flat[5]
    near = [(r["doc_id"], r["text"]) for r in base[2][1](spark, table, SF).collect()]
    want = jaccard_components([(r[0], r[1]) for r in rows if r[0] not in (100, 101, 102)], 5, 80)
    assert sorted(d for d, _ in near) == sorted({c for _, c in want})
    left = {r["doc_id"] for r in base[3][1](spark, table, SF).collect()}
    assert 105 not in left
    done = base[4][1](spark, table, SF).collect()
    assert len(done) == len(rows) - 3 and all(len(r["ids"]) == r["n_tokens"] for r in done)


def test_short_benchmark_items_are_found(spark, tmp_path):
    items = [("q1", "Paris"), ("q2", "forty two"), ("q3", "not in any of them"), ("q4", "one two three four five six")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["it is paris, of course", "the answer is forty-two", "forty and two", "one two three four", "x one two three four five six y", "parisian"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = dict(corpus_pipeline.STAGES)["decontaminate"](spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]


def test_run_over_whole_table(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.7 * n < out.count() <= n
