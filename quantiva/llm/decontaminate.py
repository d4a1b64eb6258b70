"""Benchmark decontamination by a prefix-filtered set join.

Windows of benchmark items (ten consecutive words; a shorter item is one
window) are sets of three-word shingles.  The shingles are counted over all
documents and ordered by rarity.  A window can only occur where all its
shingles do, so its prefix of necessary tokens is its one rarest shingle:
documents are joined on that, the length and position bounds drop windows
that would begin before the text or end after it, and the words of the rest
are compared one by one.

The benchmark is handled in blocks of at most ``BLOCK_BYTES`` of text, each
sent to the tasks whole; documents pass through the blocks one after another
in the same stage, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, packed, text_column, unpacked
from .words import Hasher, alnum_separators, ngrams

BLOCK_BYTES = 32 << 20
SHINGLE = 3
_U = np.uint64
_STATE = "spans array<struct<start:bigint,end:bigint>>, items array<string>, n_words bigint"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


class Windows:
    """Distinct windows of one block of items, and which items have them."""

    def __init__(self, ids: list[str], texts: list[str], window: int, min_words: int):
        hasher = Hasher(alnum_separators())
        raw = [t.encode("utf-8") for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        found: dict[bytes, int] = {}
        words, pairs = [], set()
        names = {x: k for k, x in enumerate(sorted(set(ids)))}
        self.names = list(names)
        for a, _, bounds, h in hasher.words(np.frombuffer(b"".join(raw), np.uint8), offsets):
            for k in range(len(bounds) - 1):
                own = h[bounds[k]:bounds[k + 1]]
                if not len(own) or len(own) < min_words:
                    continue
                size = min(window, len(own))
                for i in range(len(own) - size + 1):
                    w = own[i:i + size]
                    at = found.setdefault(w.tobytes(), len(found))
                    if at == len(words):
                        words.append(w)
                    pairs.add((at, names[ids[a + k]]))
        self.length = np.array([len(w) for w in words], np.int64)
        self.words = np.zeros((len(words), window), _U)
        for k, w in enumerate(words):
            self.words[k, : len(w)] = w
        both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.item = both[:, 1]
        self.item_from = np.searchsorted(both[:, 0], np.arange(len(words) + 1))
        # shingles by (size, hash); windows of fewer than three words have one of their own size
        self.shingles = {}
        self.of = []
        for k, w in enumerate(words):
            size = min(SHINGLE, len(w))
            self.of.append((size, ngrams(w, size)))
        for size in sorted({s for s, _ in self.of}):
            self.shingles[size] = np.unique(np.concatenate([g for s, g in self.of if s == size]))

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep for each window its rarest shingle (count, then hash) and where it stands in it."""
        rare = {s: [] for s in self.shingles}
        for k, (size, grams) in enumerate(self.of):
            at = np.searchsorted(self.shingles[size], grams)
            n = [counts.get((size, int(i)), 0) for i in at]
            if min(n):  # a shingle that no document has: the window occurs nowhere
                best = min(range(len(n)), key=lambda j: (n[j], int(grams[j])))
                rare[size].append((int(at[best]), k, best))
        self.postings = {}
        for size, rows in rare.items():
            if rows:
                p = np.array(sorted(rows), np.int64)
                tokens = np.unique(p[:, 0])
                self.postings[size] = (self.shingles[size][tokens],
                                       np.searchsorted(p[:, 0], np.append(tokens, 1 << 62)), p[:, 1], p[:, 2])
        del self.of, self.shingles


def member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``values`` that are in the sorted ``table``, and where there."""
    if not len(table) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.zeros(1 << 20, bool)
    bits[table >> _U(44)] = True
    some = np.flatnonzero(bits[values >> _U(44)])
    at = np.searchsorted(table, values[some])
    at[at == len(table)] = 0
    ok = table[at] == values[some]
    return some[ok], at[ok]


def _grams(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a batch that lie within one text: (first word, hash)."""
    g = ngrams(h, size)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(text[: len(g)] == text[size - 1: size - 1 + len(g)])
    return inside, g[inside]


def count_shingles(texts: DataFrame, windows) -> dict[tuple[int, int], int]:
    """How often each benchmark shingle of one block occurs in all texts."""

    def run(batches):
        tables = unpacked(windows).shingles
        hasher = Hasher(alnum_separators())
        seen = {s: np.zeros(len(t), np.int64) for s, t in tables.items()}
        for b in batches:
            for _, _, bounds, h in hasher.words(*text_column(b, "text")):
                for s, table in tables.items():
                    seen[s] += np.bincount(member(_grams(h, bounds, s)[1], table)[1], minlength=len(table))
        for s, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s), pa.int32()), pa.array(at, pa.int64()),
                                              pa.array(n[at], pa.int64())], ["size", "token", "n"])

    rows = texts.select("text").mapInArrow(run, "size int, token bigint, n bigint").groupBy("size", "token").agg(
        F.sum("n").alias("n")).collect()  # at most the shingles of one block of the benchmark
    return {(r["size"], r["token"]): r["n"] for r in rows}


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _match(w: Windows, h: np.ndarray, bounds: np.ndarray) -> dict[int, tuple[np.ndarray, set]]:
    """For each text with occurrences: (mask of its words, item numbers)."""
    starts, which = [], []
    for size, (tokens, first, window, offset) in w.postings.items():
        inside, g = _grams(h, bounds, size)
        pos, tok = member(g, tokens)
        pos = inside[pos]
        n = first[tok + 1] - first[tok]
        rows = np.repeat(first[tok], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        k, at = window[rows], np.repeat(pos, n) - offset[rows]
        text = np.searchsorted(bounds, np.repeat(pos, n), side="right") - 1
        fits = (at >= bounds[text]) & (at + w.length[k] <= bounds[text + 1])
        k, at = k[fits], at[fits]
        same = np.ones(len(k), bool)
        for j in range(w.words.shape[1]):
            long = w.length[k] > j
            same &= ~long | (h[np.minimum(at + j, len(h) - 1)] == w.words[k, j])
        starts.append(at[same])
        which.append(k[same])
    out = {}
    if not starts:
        return out
    at, k = np.concatenate(starts), np.concatenate(which)
    text = np.searchsorted(bounds, at, side="right") - 1
    for t in np.unique(text):
        own = text == t
        n = int(bounds[t + 1] - bounds[t])
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at[own] - bounds[t], 1)
        np.add.at(edge, at[own] - bounds[t] + w.length[k[own]], -1)
        items = {int(x) for j in np.unique(k[own]) for x in w.item[w.item_from[j]:w.item_from[j + 1]]}
        out[int(t)] = (np.cumsum(edge)[:n] > 0, items)
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, min_item_words: int = 1,
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The input rows' columns (or those named in ``columns``) plus n_words, n_hit, spans (word ranges [start, end)) and items (ids as text, sorted).

    A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A word is hit if it lies in any
    occurrence of a window.  Null texts have no words; items without an id or without words take
    no part, nor do items of fewer than ``min_item_words`` words; rows of one item id are taken
    together.  Repeated documents and ids give one row each; empty tables give empty results or
    no hits; input columns with the names of the new ones are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = ["n_words", "n_hit", "spans", "items"]
    names = [c for c in (docs.columns if columns is None else columns) if c.lower() not in own]
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("id"),
                             F.col(f"`{item_text_col}`").alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    carried = {c: f"c{k}" for k, c in enumerate(names) if c != text_col}
    keep = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in carried.items()],
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    out = keep
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        rows = part.collect()  # one block: BLOCK_BYTES on average
        w = Windows([r["id"] for r in rows], [r["text"] for r in rows], window, min_item_words)
        w.order(count_shingles(keep, spark.sparkContext.broadcast(packed(w))))
        out = _pass(out, spark.sparkContext.broadcast(packed(w)), first=k == 0, with_text=k < blocks - 1 or text_col in names)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select(*[F.col(carried.get(c, "text")).alias(c) for c in names], "n_words", hit.alias("n_hit"), "spans",
                      "items")


def _pass(df: DataFrame, shared, first: bool, with_text: bool) -> DataFrame:
    state = ["spans", "items", "n_words"]
    through = [f for f in df.schema.fields if f.name not in state and (with_text or f.name != "text")]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in through] + [_STATE])
    names = [f.name for f in through] + state

    def run(batches):
        w = unpacked(shared)
        hasher = Hasher(alnum_separators())
        for b in batches:
            n = b.num_rows
            if first:
                spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
                count = np.zeros(n, np.int64)
            else:
                spans = [[(s["start"], s["end"]) for s in x] for x in b.column("spans").to_pylist()]
                items, count = b.column("items").to_pylist(), None
            for lo, hi, bounds, h in hasher.words(*text_column(b, "text")):
                if count is not None:
                    count[lo:hi] = np.diff(bounds)
                for t, (mask, found) in _match(w, h, bounds).items():
                    for s, e in spans[lo + t]:
                        mask[s:e] = True
                    spans[lo + t] = _spans(mask)
                    items[lo + t] = sorted({w.names[x] for x in found} | set(items[lo + t]))
            yield pa.RecordBatch.from_arrays(
                [b.column(x) for x in names[:-3]] +
                [pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(_SPAN)),
                 pa.array(items, pa.list_(pa.string())),
                 pa.array(count, pa.int64()) if count is not None else b.column("n_words")], names)

    return df.mapInArrow(run, schema)
