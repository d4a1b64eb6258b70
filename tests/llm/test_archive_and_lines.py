import base64
import hashlib

import pytest

from quantiva.llm import line_dedup, warc
from quantiva.llm.common import scratch_dir


def brute_records(rows, least):
    first = {}
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        f = first.get(p) if len(p) >= least else None
        f = None if f is None or i == f else f
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if f is None else "revisit", f))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 3])
def test_warc_round_trip(spark, least):
    rows = [(5, "http://a/1", "<p>x</p>", 1), (3, "http://a/2", "<p>x</p>", 2), (9, None, "<p>x</p>", 3), (1, "u v\r\nw", None, 4),
            (2, "", "", 5), (4, "http://b", "ab", 6), (6, "http://b", "ab", 7), (7, "c", "é漢" * 5000, 8), (3, "http://a/2", "<p>x</p>", 2),
            (None, "n", "only null id", 9), (None, "n", "ab", 9), (None, "n", "<p>x</p>", 9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int")
    path = scratch_dir(spark, "warc-test")
    warc.write_archive(pages, path, min_revisit_bytes=least)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in rows})
    read = warc.read_archive(spark, path)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read.collect()]
    assert sorted(got, key=repr) == brute_records(rows, least)
    for r in warc.record_bytes(read).collect():
        head, _, body = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert int(fields[b"Content-Length"]) == len(body) - 4
        whole = bytes(r["payload"])
        assert body[:-4] == (whole if r["record_type"] == "response" else b"")
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(whole).digest())


def test_warc_empty_table_and_broken_payload(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    path = scratch_dir(spark, "warc-empty")
    warc.write_archive(pages, path)
    assert warc.read_archive(spark, path).collect() == []
    path = scratch_dir(spark, "warc-broken")
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], pages.schema), path)
    spark.read.parquet(f"{path}/payloads").selectExpr("payload_sha256", "cast('y' as binary) as payload") \
        .write.parquet(f"{path}/other/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}/other/records")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, f"{path}/other").collect()


def brute_lines(rows):
    """(id, text) -> text after removal; rows in the order id (nulls last), then as given by distinct text."""
    def key(r):
        raw = "\x00".join([str(r[0]) if r[0] is not None else "\x01", r[1] or ""])
        return (r[0] is None, r[0] or 0, hashlib.md5(raw.encode()).digest())

    seen, out = set(), {}
    for r in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=key):
        lines = r[1].split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            run = "\n".join(lines[i:i + 3])
            if not run.strip():
                continue
            if run in seen:
                gone.update((i, i + 1, i + 2))
            seen.add(run)
        out[r] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_line_dedup_against_brute_force(spark):
    block = "one\ntwo\nthree\nfour"
    rows = [(1, f"start\n{block}\nend"), (2, f"other\n{block}\nmore\nlines"), (3, block), (3, block), (4, "one\ntwo"), (5, None), (6, ""),
            (7, "a\na\na\na\na\na"), (8, "\n\n\n\n"), (9, "\n\n\n"), (None, f"{block}\nnull id"), (10, "one\ntwo\nfour\nthree"),
            (11, "x\n" * 3000 + "tail"), (12, " \n\t\n "), (3, f"{block}\nsame id"), (13, "three\nfour\nend"), (14, "end\r\na\r\nb"), (15, "end\r\na\r\nb")]
    docs = spark.createDataFrame([(*r, "keep", 5) for r in rows], "doc_id bigint, text string, removed string, N_Lines int").repartition(4)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "removed", "n_lines", "n_removed"]
    want = brute_lines(rows)
    expected = sorted(((d, *(want[(d, t)] if t is not None else (None, 0, 0))) for d, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()), key=repr) == expected
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []
