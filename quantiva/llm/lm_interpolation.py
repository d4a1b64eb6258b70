"""Language-model scoring by deleted interpolation.

p(w | h) = l2[b] * c(h, w) / c(h) + l1[b] * c(w) / N + l0[b] / (V + 1), where b is the bucket
(power of two) of the context's count c(h).  A part of the learning documents
is "deleted": the weights l of each bucket are learned by expectation
maximisation on that part's n-gram counts, with estimates from the retained
part; scores then use the counts of all learning documents.

The documents are dealt into blocks of about ``BLOCK_BYTES`` of text by a hash
of the row.  Each block reports its distinct words and word pairs, as sorted
64-bit hashes with counts, to the shards of the hash space; each shard adds
the blocks' counts and sends every block the totals of the n-grams that it
asked for, in the block's own order.  So a word or pair moves once for each
block that has it, however often it occurs there, and nothing that grows with
the corpus is collected or broadcast.  Rows that repeat an id and its text would
all fall into one block: where they have more text than a block, the rows are
written once with a number each, and dealt by it.

The weights need the counts of context and word for every pair of the deleted
part; these pairs are joined with the table of word counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, pack, stored, text_column, unpack
from .words import Hasher, blank_separators, mix

BLOCK_BYTES = 8 << 20
TOKENS_A_SHARD = 3_000_000
DELETED_ONE_IN = 32
ITERATIONS = 12
BUCKETS = 40
LEAST_UNIFORM = 1e-4
_U = np.uint64
# Keys of the end of a text and of the context before its first word: no word has length 0.
END, START = _U(0x5A17E0D1C0FFEE01), _U(0x5A17E0D1C0FFEE02)
_TEST, _DELETED, _RETAINED = 0, 1, 2


class Block:
    """Tokens of one block of texts, with its distinct words and pairs in the order of their keys."""

    def __init__(self, table: pa.Table):
        batch = table.combine_chunks().to_batches()
        raw, offsets = text_column(batch[0], "text")
        hasher = Hasher(blank_separators())
        parts, sizes = [], []
        for _, _, bounds, h in hasher.words(raw, offsets):
            n = np.diff(bounds)
            whole = np.full(len(h) + len(n), END, _U)
            ends = np.cumsum(n + 1) - 1
            words = np.ones(len(whole), bool)
            words[ends] = False
            whole[words] = h
            parts.append(whole)
            sizes.append(n + 1)
        self.tokens = np.concatenate(parts)
        self.sizes = np.concatenate(sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        context = np.empty(len(self.tokens), _U)
        context[1:] = self.tokens[:-1]
        context[self.first] = START
        self.context = context
        self.words, self.word_of = np.unique(self.tokens, return_inverse=True)
        self.pairs, self.pair_of = np.unique(mix(mix(context) + self.tokens), return_inverse=True)


def _shard_ranges(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the shards in sorted keys (shards: a power of two; a shard is a range of keys)."""
    bits = shards.bit_length() - 1
    if not bits:
        return np.array([0, len(keys)])
    edges = np.arange(1, shards, dtype=_U) << _U(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=_U(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=_U)


REPORT = "shard int, block int, kind int, keys binary, retained binary, deleted binary, contexts binary, words binary"
TOTALS = "kind int, block int, shard int, counts binary, a bigint, b bigint, retained bigint, n bigint"
_WORDS, _PAIRS, _EVENT, _VOCABULARY, _SIZES = 1, 2, 3, 4, 5


def _report(shards: int):
    def run(key, table):
        block = Block(table)
        role = np.repeat(np.asarray(table.column("role").to_numpy()), block.sizes)
        out = []
        for kind, keys, of in ((_WORDS, block.words, block.word_of), (_PAIRS, block.pairs, block.pair_of)):
            counts = [np.bincount(of[role == r], minlength=len(keys)) for r in (_RETAINED, _DELETED)]
            context = word = np.zeros(0, _U)
            if kind == _PAIRS:
                where = np.zeros(len(keys), np.int64)
                where[of] = np.arange(len(of))
                context, word = block.context[where], block.tokens[where]
            bounds = _shard_ranges(keys, shards)
            for s in range(shards):
                own = slice(bounds[s], bounds[s + 1])
                if bounds[s] < bounds[s + 1]:
                    some = counts[1][own] > 0
                    out.append((s, int(key[0].as_py()), kind, pack_sorted(keys[own]), pack(counts[0][own]), pack(counts[1][own]),
                                pack(context[own][some]) if kind == _PAIRS else b"",
                                pack(word[own][some]) if kind == _PAIRS else b""))
        cols = list(zip(*out))
        types = [pa.int32()] * 3 + [pa.binary()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)],
                        ["shard", "block", "kind", "keys", "retained", "deleted", "contexts", "words"])

    return run


def _add(key, table):
    """Totals of one shard for every block, its vocabulary, and the pairs of the deleted part."""
    out = {n: [] for n in ("kind", "block", "shard", "counts", "a", "b", "retained", "n")}

    def emit(kind, rows, **cols):
        out["kind"].append(np.full(rows, kind))
        for n in ("block", "shard", "a", "b", "retained", "n"):
            out[n].append(np.asarray(cols.get(n, np.zeros(rows, np.int64))))
        out["counts"] += cols.get("counts", [None] * rows)

    shard = key[0].as_py()
    kinds = table.column("kind").to_numpy()
    for kind in (_WORDS, _PAIRS):
        rows = np.flatnonzero(kinds == kind).tolist()
        if not rows:
            continue
        get = lambda name: [table.column(name)[i].as_py() for i in rows]  # noqa: B023,E731
        keys = [unpack_sorted(x) for x in get("keys")]
        retained, deleted = [unpack(x) for x in get("retained")], [unpack(x) for x in get("deleted")]
        every, of = np.unique(np.concatenate(keys), return_inverse=True)
        r = np.bincount(of, np.concatenate(retained), len(every)).astype(np.int64)
        d = np.bincount(of, np.concatenate(deleted), len(every)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        total = r + d
        emit(kind, len(rows), block=np.array(get("block")), shard=np.full(len(rows), shard),
             counts=[pack(total[of[e - len(k):e]]) for e, k in zip(ends, keys)])
        if kind == _WORDS:
            some = np.flatnonzero(total)
            emit(_VOCABULARY, len(some), a=every[some].view(np.int64), retained=r[some], n=total[some])
            emit(_SIZES, 1, a=[len(some)], retained=[r.sum()], n=[total.sum()])
        else:
            here = [np.flatnonzero(x) for x in deleted]
            at = np.concatenate([of[e - len(k):e][h] for e, k, h in zip(ends, keys, here)])
            context = np.concatenate([unpack(x) for x in get("contexts")])
            word = np.concatenate([unpack(x) for x in get("words")])
            _, one = np.unique(at, return_index=True)
            emit(_EVENT, len(one), a=context[one].view(np.int64), b=word[one].view(np.int64), retained=r[at[one]], n=d[at[one]])
    cast = {"kind": np.int32, "block": np.int32, "shard": np.int32}
    cols = [pa.array(out["counts"], pa.binary()) if n == "counts" else pa.array(np.concatenate(v).astype(cast.get(n, np.int64)))
            for n, v in out.items()]
    return pa.table(cols, list(out))


def learn_weights(events: DataFrame, n_retained: int, vocabulary: int) -> np.ndarray:
    """Weights [BUCKETS, 3] (pair, word, uniform) by expectation maximisation.

    events: pair (count of the pair in the retained part), context, word (theirs), n (times in the
    deleted part).  Every iteration is one aggregation by bucket.  A bucket without events has the
    weights of the nearest smaller one that has some.
    """
    f2 = F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0)
    rows = events.select(bucket_column(F.col("context")).alias("bucket"), f2.alias("f2"),
                         (F.col("word") / F.lit(float(max(n_retained, 1)))).alias("f1"), "n")
    rows = stored(rows.groupBy("bucket", "f2", "f1").agg(F.sum("n").alias("n")), "lm-events")
    f0 = F.lit(1.0 / (vocabulary + 1))
    weights = np.full((BUCKETS, 3), 1 / 3)
    seen = np.zeros(BUCKETS, bool)
    for _ in range(ITERATIONS):
        w = [F.get(F.array(*[F.lit(float(x)) for x in weights[:, j]]), F.col("bucket")) for j in range(3)]
        parts = rows.select("bucket", "n", (w[0] * F.col("f2")).alias("x2"), (w[1] * F.col("f1")).alias("x1"),
                            (w[2] * f0).alias("x0")).withColumn("p", F.col("x2") + F.col("x1") + F.col("x0"))
        sums = parts.groupBy("bucket").agg(*[F.sum(F.col("n") * F.col(x) / F.col("p")).alias(x) for x in ("x2", "x1", "x0")])
        for r in sums.collect():  # BUCKETS rows
            x = np.array([r["x2"], r["x1"], r["x0"]], float)
            seen[r["bucket"]] = True
            weights[r["bucket"]] = x / x.sum()
    weights[:, 2] = np.maximum(weights[:, 2], LEAST_UNIFORM)
    weights /= weights.sum(axis=1, keepdims=True)
    for b in range(1, BUCKETS):
        if not seen[b] and seen[b - 1]:
            weights[b], seen[b] = weights[b - 1], True
    return weights


def bucket_column(count):
    """0 for a context never seen, else 1 + floor(log2(count)), at most BUCKETS - 1."""
    return F.when(count <= 0, 0).otherwise(F.least(F.length(F.bin(count)), F.lit(BUCKETS - 1))).cast("int")


def _buckets(count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(count), np.int64)
    some = count > 0
    out[some] = np.minimum(np.frexp(count[some].astype(np.float64))[1], BUCKETS - 1)
    return out


def _score(shards: int, weights: np.ndarray, tokens: int, vocabulary: int, learned: int):
    def run(key, docs, totals):
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in (docs.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(),
                                                       pa.float64(), pa.float64())],
                            ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        block = Block(docs)
        kinds, shard = totals.column("kind").to_numpy(), totals.column("shard").to_numpy()
        counts = []
        for kind, size in ((_WORDS, len(block.words)), (_PAIRS, len(block.pairs))):
            rows = np.flatnonzero(kinds == kind)
            rows = rows[np.argsort(shard[rows], kind="stable")].tolist()
            parts = [unpack(totals.column("counts")[i].as_py()) for i in rows]
            counts.append(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64))
            if len(counts[-1]) != size:
                raise RuntimeError("totals do not match the block's n-grams")
        c1 = counts[0][block.word_of]
        c2 = counts[1][block.pair_of]
        context = np.empty_like(c1)
        context[1:] = c1[:-1]
        context[block.first] = learned
        w = weights[_buckets(context)]
        with np.errstate(divide="ignore", invalid="ignore"):
            f2 = np.where(context > 0, c2 / context, 0.0)
        p = w[:, 0] * f2 + w[:, 1] * (c1 / max(tokens, 1)) + w[:, 2] / (vocabulary + 1)
        base = np.log10((c1 + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        add = lambda x: np.add.reduceat(x, block.first)
        return pa.table([docs.column("doc_id"), docs.column("held_out"), pa.array(block.sizes, pa.int64()),
                         pa.array(add((c1 > 0).astype(np.int64)), pa.int64()), pa.array(add(base)), pa.array(add(np.log10(p)))],
                        ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row.

    A-Z are lower-cased; tokens are the words ``[^\\x20\\x09-\\x0D]+`` and one end.  Learned from the rows whose
    crc32(id as text) mod ``folds`` is not ``fold`` (``held_out`` are the others).  ``base_score`` is
    the add-a-half unigram score, ``score`` the model's log10 probability of the text.

    Null text is empty (one token, the end); null and repeated ids and repeated rows pass through,
    one row each; texts are read whole; other columns are ignored; an empty table gives an empty
    result; without learning rows the probabilities are uniform over one unseen word.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {key}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    test = held_out("doc_id", folds, fold)
    mark = F.xxhash64("doc_id", "text")
    alike = rows.groupBy(mark.alias("mark")).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"),
                                                 F.count(F.when(~test, 1)).alias("learned"))
    size = alike.agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.sum("learned").alias("learned"),
                     F.max(F.when(F.col("n") > 1, F.col("b"))).alias("repeated")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema).select("doc_id", "held_out", "n_tokens", "n_known",
                                                        F.lit(0).cast("bigint").alias("train_tokens"), "base_score", "score")
    blocks = max(1, -(-(size["b"] or 0) // BLOCK_BYTES))
    shards = 1 << max(0, (((size["b"] or 0) // 6 + size["n"]) // TOKENS_A_SHARD).bit_length())
    deal = mark
    if (size["repeated"] or 0) > BLOCK_BYTES:
        rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "lm-rows")
        deal = F.xxhash64(mark, "place")
    rows = rows.select("doc_id", "text", test.alias("held_out"),
                       F.when(test, _TEST).when(F.pmod(F.xxhash64(mark, F.lit("deleted")), F.lit(DELETED_ONE_IN)) == 0, _DELETED)
                       .otherwise(_RETAINED).alias("role"), F.pmod(deal, F.lit(blocks)).cast("int").alias("block"))
    reports = rows.select("block", "text", "role").groupBy("block").applyInArrow(_report(shards), REPORT)
    totals = stored(reports.groupBy("shard").applyInArrow(_add, TOTALS), "lm-totals")
    sizes = totals.filter(F.col("kind") == _SIZES).agg(F.sum("a").alias("v"), F.sum("retained").alias("r"), F.sum("n").alias("n")).first()
    vocabulary, n_retained, tokens = (int(sizes[x] or 0) for x in ("v", "r", "n"))
    words = totals.filter(F.col("kind") == _VOCABULARY).select(F.col("a").alias("key"), F.col("retained").alias("count"))
    retained_docs = rows.filter(F.col("role") == _RETAINED).count()
    start = int(np.array([START]).view(np.int64)[0])
    events = totals.filter(F.col("kind") == _EVENT).select("a", "b", F.col("retained").alias("pair"), "n")
    events = events.join(words.withColumnsRenamed({"key": "a", "count": "context"}), "a", "left")
    events = events.join(words.withColumnsRenamed({"key": "b", "count": "word"}), "b", "left")
    events = events.select(
        "pair", F.when(F.col("a") == start, retained_docs).otherwise(F.coalesce("context", F.lit(0))).cast("bigint").alias("context"),
        F.coalesce("word", F.lit(0)).alias("word"), "n")
    weights = learn_weights(events, n_retained, vocabulary)
    asked = totals.filter(F.col("kind").isin(_WORDS, _PAIRS)).select("block", "kind", "shard", "counts")
    scored = rows.select("block", "doc_id", "held_out", "text").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        _score(shards, weights, tokens, vocabulary, size["learned"]), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
                         "base_score", "score")
