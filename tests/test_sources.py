"""Sources and sinks: xlsx (S2/S4), CSV union (S3), storage (S7/S8/S12), admission."""

import contextlib
import io
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from quantiva.errors import NotFoundError
from quantiva.session import scratch_dir
from quantiva.sources import admission, csv as csvsrc, storage
from quantiva.sources.xlsx import read_xlsx
from tests.xlsx_writer import write_xlsx


def test_xlsx_sheets_union_and_lineage(spark):
    d = tempfile.mkdtemp(prefix="qv-xlsx-")
    write_xlsx(os.path.join(d, "two.xlsx"), {
        "north": [["name", "salary"], ["a", 10], ["b", 20]],
        "south": [["name", "salary", "dept"], ["c", 30, "x"], ["d", "N/A", "y"]],
        "empty": [],
    })
    write_xlsx(os.path.join(d, "one.xlsx"), {"only": [["name", "salary"], ["e", 50]]})
    df = read_xlsx(spark, d)
    rows = {r["name"]: r for r in df.collect()}
    assert set(rows) == {"a", "b", "c", "d", "e"}
    assert dict(df.dtypes)["salary"] == "bigint" and rows["d"]["salary"] is None
    assert rows["c"]["__source_sheet__"] == "south" and rows["e"]["__source_sheet__"] is None
    assert rows["e"]["__source_file__"] == "one.xlsx" and rows["a"]["dept"] is None


def test_xlsx_single_sheet_has_no_sheet_column(spark):
    d = tempfile.mkdtemp(prefix="qv-xlsx-")
    write_xlsx(os.path.join(d, "one.xlsx"), {"s": [["k", "v"], [1, 2.5], [2, 3.5]]})
    df = read_xlsx(spark, os.path.join(d, "one.xlsx"))
    assert "__source_sheet__" not in df.columns and dict(df.dtypes)["v"] == "double"


def test_csv_union_by_header(spark):
    base = tempfile.mkdtemp(prefix="qv-csv-")
    with open(os.path.join(base, "a.csv"), "w") as f:
        f.write("id,x\n1,10\n2,20\n")
    with open(os.path.join(base, "b.csv"), "w") as f:
        f.write("id,y\n3,NA\n4,b\n")
    open(os.path.join(base, "empty.csv"), "w").close()
    df = csvsrc.read_csv(spark, base)
    got = {r["id"]: r for r in df.collect()}
    assert set(got) == {1, 2, 3, 4} and got[3]["y"] is None and got[1]["y"] is None
    assert got[4]["__source_file__"] == "b.csv"


def test_storage_roundtrip_and_missing(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    path = scratch_dir(spark, "t-store")
    meta = storage.save_dataset(df, path, {"k": "v"}).collect()[0]
    assert meta["data_shape"] == [25, 3] and meta["k"] == "v"
    data, _ = storage.load_dataset(spark, path)
    assert data.exceptAll(df).count() == 0
    with pytest.raises(NotFoundError):
        storage.load_dataset(spark, path + "-nope")
    st = storage.storage_stats(spark, "/root/testdata/sf0.001", "*.parquet").collect()
    assert len(st) == 14 and all(r["size_bytes"] > 0 for r in st)


def test_file_admission(spark):
    d = tempfile.mkdtemp(prefix="qv-adm-")
    for n, size in [("a.csv", 10), ("b.txt", 10), ("c.xlsx", 300)]:
        with open(os.path.join(d, n), "wb") as f:
            f.write(b"x" * size)
    r = {x["file_name"]: x for x in admission.file_admission(spark, d, max_bytes=100).collect()}
    assert r["a.csv"]["accepted"] and not r["b.txt"]["accepted"] and not r["c.xlsx"]["accepted"]
    assert "Unsupported file type: .txt" in r["b.txt"]["reason"] and "too large" in r["c.xlsx"]["reason"]


def test_csv_gzip_header(spark):
    import gzip
    base = tempfile.mkdtemp(prefix="qv-gz-")
    with gzip.open(os.path.join(base, "a.csv.gz"), "wt") as f:
        f.write("id,x\n1,2.5\n2,3.5\n")
    df = csvsrc.read_csv(spark, base)
    assert sorted(df.columns) == ["__source_file__", "id", "x"] and dict(df.dtypes)["x"] == "double"
    assert df.count() == 2


def _csv(folder, name, text):
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def test_csv_quotes_line_breaks_and_blank_lines(spark):
    base = tempfile.mkdtemp(prefix="qv-csv-")
    _csv(base, "q.csv", 'id,t\n1,"a ""b"", c"\n2,"two\nlines, here"\n3,plain\n')
    _csv(base, "b.csv", "\n\nid,t\n4,x\n5\n")
    got = {r["id"]: r["t"] for r in csvsrc.read_csv(spark, base).collect()}
    assert got == {1: 'a "b", c', 2: "two\nlines, here", 3: "plain", 4: "x", 5: None}


def test_csv_extra_fields_are_an_error(spark):
    base = tempfile.mkdtemp(prefix="qv-csv-")
    _csv(base, "a.csv", "id,t\n1,x\n2,y,z\n")
    with pytest.raises(Exception, match="More fields than in the header"):
        csvsrc.read_csv(spark, base).collect()


def test_csv_round_trip_of_awkward_text(spark):
    texts = ['"', '""', 'a,b', "line\nbreak", '"quoted" and, more\n"again"', "tab\there", "é漢", "\\ back \\\" slash"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    path = scratch_dir(spark, "csv-awkward")
    csvsrc.write_csv(df, path)
    assert {r["id"]: r["t"] for r in csvsrc.read_csv(spark, path).collect()} == dict(enumerate(texts))


def test_ingest_saves_and_reports(spark):
    from quantiva.operators.summary import ingest
    base, dest = tempfile.mkdtemp(prefix="qv-csv-"), scratch_dir(spark, "ingested")
    _csv(base, "a.csv", "id,x\n1,10\n2,N/A\n2,N/A\n")
    r = ingest(spark, base, dest).collect()[0]
    assert (r["total_rows"], r["duplicate_rows"], r["file_names"]) == (3, 1, ["a.csv"])
    data, meta = storage.load_dataset(spark, dest)
    assert data.count() == 3 and meta.collect()[0]["saved_at"]


def test_quoted_line_breaks_in_many_byte_ranges(spark):
    """A quoted file is read by many tasks; records equal Python's csv module for every split of the file."""
    import csv as pycsv
    import io
    import random

    r = random.Random(6)
    rows = []
    for i in range(700):
        t = r.choice(["plain", 'a "quoted" word', "two\nlines", "crlf\r\ninside", "c,o,m", "", "x" * 300, '"', '""', ',"\n', "é\n漢", 'end"\n"start'])
        rows.append([str(i), t, r.choice(["y", "multi\n\nline", 'tail"'])])
    out = io.StringIO()
    pycsv.writer(out, lineterminator="\n").writerows([["id", "t", "u"], *rows])
    # a quote inside an unquoted field is a plain character
    text = out.getvalue() + '700,5" pipe,z\n701,"open\n""close""",6" x 4"\n'
    rows += [["700", '5" pipe', "z"], ["701", 'open\n"close"', '6" x 4"']]
    base = tempfile.mkdtemp(prefix="qv-csv-")
    for name, body in (("a.csv", text), ("b.csv", "id,t,u\r\n1,\"p\r\nq\",r\r\n"), ("c.csv", 'id,t,u\n9,"never closed\n8,x,y\n')):
        with open(os.path.join(base, name), "w", newline="") as f:
            f.write(body)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("500", "4001", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            df = csvsrc.read_csv(spark, [os.path.join(base, "a.csv"), os.path.join(base, "b.csv")], null_values=[], infer=False)
            got = df.collect()
            mine = {x["id"]: [x["t"] or "", x["u"] or ""] for x in got if x["__source_file__"] == "a.csv"}
            assert len(got) == len(rows) + 1 and mine == {a: [b, c] for a, b, c in rows}
            assert [(x["id"], x["t"], x["u"]) for x in got if x["__source_file__"] == "b.csv"] == [("1", "p\r\nq", "r")]
            parts = csvsrc.records(spark, [os.path.join(base, "a.csv")]).select("start").distinct().count()
            assert parts > 20 if size == "500" else parts >= 1
        assert csvsrc.records(spark, [os.path.join(base, "c.csv")]).count() == 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _shuffled(df):
    """Names of the columns that the plan of ``df`` shuffles."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    inputs = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]$", out.getvalue(), re.M)
    return [re.sub(r"#\d+L?$", "", c) for columns in inputs for c in columns.split(", ")]


def test_quoted_csv_is_cut_where_it_is_read_and_once(spark, monkeypatch):
    """Lines and whole records are not shuffled; only pieces of records that go over an end of a range are."""
    base = tempfile.mkdtemp(prefix="qv-csv-")
    _csv(base, "q.csv", "id,t\n" + "".join(f'{i},"two {i}\nlines, here"\n' for i in range(50)))
    shuffled, names, plain = [], [], csvsrc.stored_table

    def watched(df, name):
        names.append(name)
        shuffled.extend(_shuffled(df))
        return plain(df, name)

    monkeypatch.setattr(csvsrc, "stored_table", watched)
    df = csvsrc.read_csv(spark, base, infer=False)
    assert len(df.collect()) == 50
    shuffled += _shuffled(df)
    assert shuffled and not {"value", "text"} & set(shuffled)
    assert "csv-records" in names


def test_records_over_many_byte_ranges(spark):
    """Blank lines first, records longer than a byte range, bytes that are no UTF-8 (replaced), odd file names."""
    base = tempfile.mkdtemp(prefix="qv-csv-")
    long = [("line " * 30 + "\n") * 40, "no break " * 500, "\n" * 3000, '"\n' * 700]
    body = b"\n" * 900 + b"id,t\n" + b"".join(
        b'%d,"%s"\n%d,\xe9t\xe9\n' % (i, t.replace('"', '""').encode(), i + 100) for i, t in enumerate(long)) + b'7,"open at\nthe end'
    for name in ("a.csv", "b+1.csv"):
        with open(os.path.join(base, name), "wb") as f:
            f.write(body)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("700", "5003", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rec = csvsrc.records(spark, [os.path.join(base, "a.csv"), os.path.join(base, "b+1.csv")])
            got = [(r["file"], bytes(r["raw"])) for r in rec.select("file", "start", "rec", F.col("text").cast("binary").alias("raw"))
                   .orderBy("file", "start", "rec").collect()]
            want = [b"id,t"]
            for i, t in enumerate(long):
                want += [b'%d,"%s"' % (i, t.replace('"', '""').encode()), "%d,\ufffdt\ufffd".encode() % (i + 100)]
            want.append(b'7,"open at\nthe end')
            assert got == [(f, t) for f in ("a.csv", "b+1.csv") for t in want]
            assert rec.count() == rec.select("path", "start", "rec").distinct().count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_distinct_counts_of_long_texts(spark):
    """Long texts are counted by a digest of fixed length; equal beginnings and texts that are digests count apart."""
    import hashlib

    from quantiva.operators import profile
    long = "x" * 500
    digest = hashlib.sha256(long.encode()).hexdigest()
    texts = [long, long, long + "y", digest, digest, "x" * 63, "x" * 64, "é" * 64, "", None]
    df = spark.createDataFrame([(t, t and t[:2]) for t in texts], "a string, b string")
    assert {r["cid"]: r["unique_count"] for r in profile.distinct_counts(df).collect()} == {
        0: len(set(texts) - {None}), 1: len({t[:2] for t in texts if t is not None})}
    assert df.select(F.max(F.length(profile._value_or_digest(df, "a", "other")))).collect()[0][0] == 64
