import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from quantiva.llm import byte_bpe, token_counts
from quantiva.llm.common import scratch_dir

ODD = ["", " ", "  ", "a", "a  b", " a", "a ", "it's we'll\n\n x", "\t\r\n", "漢字かな交じり文", "é" * 700, "😀😀 x", "▁a b", "<s></s><unk>",
       "<|endoftext|> hi", "１２٣ 4½", "\x00\x01 \x7f", "a" * 3000, "The  quick brown fox", "ﬁ Å İstanbul", "x" + " " * 500 + "y"]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(1)
    mixed = ["".join(r.choice("ab \n\t'sLé漢😀!1") for _ in range(r.randrange(80))) for _ in range(300)]
    docs = [x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return ODD + mixed + docs


def frame(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(0, texts[0], "again", 1), (None, None, None, None), (7, None, None, 2)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, ids int").repartition(3)


def test_byte_bpe_equals_the_library_and_round_trips(spark, texts):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows, df = frame(spark, texts)
    out = byte_bpe.encode(df, path, P.PATTERN)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids"], r["ids_sha256"], r["decoded_sha256"], r["round_trip"])
                  for r in out.collect()))
    want = []
    for d, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((d is None, d or 0, len(ids), ids, hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert got == sorted(want)
    back = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(out.filter("doc_id < 40"), path).collect()}
    assert all(back[i] == (texts[i] or "").encode() for i in range(8, 40))
    assert byte_bpe.encode(df.limit(0), path, P.PATTERN).collect() == []


def test_perfect_hash_is_minimal_and_finds_every_key():
    for n in (0, 1, 2, 3, 50, 2000):
        keys = [f"key{i}".encode() for i in range(n)]
        table = byte_bpe.PerfectHash(keys)
        assert sorted(table.slots.tolist()) == list(range(n))
        assert table.candidates(keys).tolist() == list(range(n))


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_equal_the_library_and_use_the_cache(spark, texts, name):
    path = P.path(name)
    if name.endswith(".model"):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    else:
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows, df = frame(spark, texts)
    cache = scratch_dir(spark, "cache")
    out = token_counts.count_tokens(df, path, cache, limit=50)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.collect()), key=key)
    want = sorted(((d, len((t or "").encode()), count(t or ""), count(t or "") > 50) for d, t, *_ in rows), key=key)
    assert got == want
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == stored.select("content_digest").distinct().count() == len({t or "" for _, t, *_ in rows})
    # a second run encodes only what is new; another tokenizer version does not use these counts
    more = df.union(spark.createDataFrame([(999, "a text never seen before", None, None)], df.schema))
    token_counts.count_tokens(more, path, cache).collect()
    assert spark.read.parquet(cache).count() == n + 1
    assert token_counts.count_tokens(df.limit(0), path).collect() == []
