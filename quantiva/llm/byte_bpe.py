"""Byte-level BPE encoding and decoding.

Two tiers.  A minimal perfect hash over the vocabulary resolves pre-tokens
that are vocabulary entries as a whole, a batch of distinct pre-tokens at a
time with numpy; the entry's bytes are compared, so nothing else is taken for
one.  Other pre-tokens are merged by rank with a heap over a doubly linked
list of their bytes (``merge_ranks``).  Decoding concatenates entries.

The hash is of the "hash and displace" kind: keys fall into buckets by a
first hash, and each bucket, largest first, gets the smallest seed that sends
its keys to free slots of a table that has exactly as many slots as keys.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, packed, slices, text_column, unpacked
from .words import mix

_U = np.uint64
_P = _U(0x100000001B3)
_PER_BUCKET = 4
_MEMO = 300_000  # pre-tokens resolved earlier in the same task


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary of a rank file (lines of base64 bytes and rank); position is the rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    entries = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(entries) != list(range(len(entries))):
        raise ValueError("ranks must run from 0 without gaps")
    return [entries[i] for i in range(len(entries))]


def hash_strings(strings: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, column by column over strings of similar length."""
    out = np.zeros(len(strings), _U)
    if not strings:
        return out
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    raw = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    h = np.full(len(strings), 0xCBF29CE484222325, _U)
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = -lengths[order]
    for k in range(int(lengths.max())):  # strings longer than k come first
        some = order[: np.searchsorted(sorted_lengths, -k, side="left")]
        h[some] = (h[some] ^ raw[starts[some] + k].astype(_U)) * _P
    return mix(h ^ (lengths.astype(_U) << _U(48)))


class PerfectHash:
    """Minimal perfect hash of a fixed list of distinct byte strings: slot -> position in the list."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // _PER_BUCKET)
        h = hash_strings(keys)
        self.seeds = np.zeros(self.buckets, _U)
        self.slots = np.full(n, -1, np.int64)
        bucket = (h % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        tries = np.arange(1, 257, dtype=_U)
        for b in sorted(range(self.buckets), key=lambda b: starts[b] - starts[b + 1]):
            own = order[starts[b]:starts[b + 1]]
            if not len(own):
                break
            base = _U(0)
            while True:
                seeds = tries + base
                at = self._slot(h[own][None, :], seeds[:, None])
                fits = free[at].all(axis=1)
                if len(own) > 1:
                    s = np.sort(at, axis=1)
                    fits &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hit = np.flatnonzero(fits)
                if len(hit):
                    k = int(hit[0])
                    self.seeds[b] = seeds[k]
                    free[at[k]] = False
                    self.slots[at[k]] = own
                    break
                base += _U(len(tries))

    def _slot(self, h, seed):
        return (mix(h ^ (seed * _U(0x9E3779B97F4A7C15))) % _U(self.n)).astype(np.int64)

    def candidates(self, strings: list[bytes]) -> np.ndarray:
        """For each string the one list position that it can have."""
        if not self.n:
            return np.full(len(strings), -1, np.int64)
        h = hash_strings(strings)
        return self.slots[self._slot(h, self.seeds[(h % _U(self.buckets)).astype(np.int64)])]


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: join the neighbours of lowest rank, leftmost first, until none can be joined."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))       # part i is piece[i:end[i]]; 0 once it has been joined to the left
    prev = list(range(-1, n - 1))
    bits = n.bit_length()
    mask = (1 << bits) - 1
    get = ranks.get
    heap = []                          # rank, start and stop of a join in one integer
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            heap.append(((r << bits | i) << bits) | i + 2)
    heapq.heapify(heap)
    while heap:
        x = heapq.heappop(heap)
        stop, i = x & mask, x >> bits & mask
        j = end[i]
        if j == 0 or j >= n or end[j] != stop:  # a neighbour has changed since
            continue
        end[j] = 0
        end[i] = stop
        if stop < n:
            prev[stop] = i
            s = get(piece[i:end[stop]])
            if s is not None:
                heapq.heappush(heap, ((s << bits | i) << bits) | end[stop])
        p = prev[i]
        if p >= 0:
            s = get(piece[p:stop])
            if s is not None:
                heapq.heappush(heap, ((s << bits | p) << bits) | stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary and pre-token pattern."""

    def __init__(self, entries: list[bytes], pattern: str, table: PerfectHash | None = None):
        import regex

        self.entries = entries
        self.ranks = {e: i for i, e in enumerate(entries)}
        self.table = table or PerfectHash(entries)
        self.find = regex.compile(pattern).findall
        self.memo = {}

    def resolve(self, pieces: list[str]) -> dict[str, list[int]]:
        """Ids of distinct pre-tokens."""
        raw = [p.encode("utf-8") for p in pieces]
        entries, out = self.entries, {}
        for piece, b, k in zip(pieces, raw, self.table.candidates(raw).tolist()):
            out[piece] = [k] if k >= 0 and entries[k] == b else merge_ranks(b, self.ranks)
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.find(t) for t in texts]
        if len(self.memo) > _MEMO:
            self.memo.clear()
        known = self.memo
        known.update(self.resolve([p for p in set(chain.from_iterable(split)) if p not in known]))
        return [np.fromiter(chain.from_iterable(map(known.__getitem__, s)), np.uint32) for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids.tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (array<int>, if ``keep_ids``), n_tokens, ids_sha256, decoded_sha256, round_trip.

    Each match of ``pattern`` is encoded by itself; there are no special
    tokens.  ``ids_sha256`` is over the ids as little-endian unsigned 32-bit
    integers, ``decoded_sha256`` over the bytes that the ids decode to,
    ``round_trip`` says that these equal the text.

    One row per input row in any order; null text is empty (no ids); very long
    texts are encoded whole; null and repeated ids pass through; an empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    entries = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast(packed((entries, PerfectHash(entries))))  # size fixed by the vocabulary
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {key}, " + "ids array<int>, " * keep_ids + \
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    names = ["doc_id"] + ["ids"] * keep_ids + ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]

    def run(batches):
        own, table = unpacked(shared)
        codec = Codec(own, pattern, table)
        for b in batches:
            raw, offsets = text_column(b, "text")
            data = raw.tobytes()
            for lo, hi in slices(offsets, 1 << 20):
                own = [data[offsets[k]:offsets[k + 1]] for k in range(lo, hi)]
                ids = codec.encode_batch([x.decode("utf-8") for x in own])
                decoded = [codec.decode(x) for x in ids]
                cols = [b.column("doc_id").slice(lo, hi - lo)]
                if keep_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                cols += [pa.array([len(x) for x in ids], pa.int64()),
                         pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                         pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                         pa.array([x == y for x, y in zip(decoded, own)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")) \
        .mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded bytes of arrays of ids (null: empty)."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    key = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [b"".join(map(shared.value.__getitem__, x or ())) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")) \
        .mapInArrow(run, f"doc_id {key}, decoded binary")
