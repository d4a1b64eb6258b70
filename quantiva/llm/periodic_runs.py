"""Maximal periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period q (words q apart are equal)
and at least max(LEAST, 2q) words, which no neighbouring word extends.

Texts of a batch are laid end to end, with a word of its own after each, so
that nothing reaches over a text's end.  Periods are handled in scales.  A
scale has blocks of c = 2**k words, one every s words, and the window of each
block begins ``first`` words after it.  The sum of squared differences between
a block and every place of its window,

    sum (x - y)**2 = sum x**2 + sum y**2 - 2 sum x * y,

comes from one convolution, a number-theoretic transform modulo 65,537: whole
numbers throughout, no rounding.  A place without mismatches has sum zero.
The stretch of equal words q apart that a run leaves is long enough to hold a
whole block of the scale that q belongs to, so no run is missed.  The distance
of every zero seeds an extension to both sides (doubling steps on prefix
hashes), and the stretch so found is compared word by word.  That comparison
also rejects zeros that are only multiples of the modulus.

A stretch of period d that has a smaller period q is the run of q too, and
was found with q; of equal stretches the smallest period is kept.  Zeros that
lie inside a known run of a period up to c are skipped: they lead to that run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, text_column
from .words import blank_separators

LEAST = 12                  # words of the shortest run
PRIME = 65_537              # 2**16 + 1: transforms of up to 2**16 places
ROOT = 3
LARGEST_BLOCK = 1 << 12     # words; longer periods are searched in several windows of this scale's size
CELLS = 1 << 19             # places transformed at once
TEXT_BYTES = 1 << 20        # texts laid end to end at once (or one text, if it is longer)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Transform:
    """Number-theoretic transform of rows of n = 2**k places.

    Matrix products of whole numbers in doubles: sums stay under 2**53, so they are exact.
    Longer rows are transformed as a table of a x b places (columns, twiddle factors, rows).
    """

    _kept: dict[int, "Transform"] = {}

    def __init__(self, n: int):
        self.n = n
        root = pow(ROOT, (PRIME - 1) // n, PRIME)
        self.a = 1 << (n.bit_length() // 2) if n > 256 else 1
        self.b = n // self.a
        powers = np.ones(n, np.int64)
        for k in range(1, n):
            powers[k] = powers[k - 1] * root % PRIME
        self.powers = powers
        self.inner, self.outer = self._matrix(self.b, powers[::self.a]), self._matrix(self.a, powers[::self.b])
        self.turn = powers[np.outer(np.arange(self.a), np.arange(self.b)) % n].astype(np.float64)
        self.scale = pow(n, -1, PRIME)

    @staticmethod
    def _matrix(n: int, powers: np.ndarray) -> np.ndarray:
        return powers[np.outer(np.arange(n), np.arange(n)) % n].astype(np.float64)

    @classmethod
    def of(cls, n: int) -> "Transform":
        if n not in cls._kept:
            cls._kept[n] = cls(n)
        return cls._kept[n]

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Rows of residues (doubles) -> their transforms (doubles)."""
        if self.a == 1:
            return np.mod(x @ self.inner, PRIME)
        m = x.reshape(-1, self.b, self.a).transpose(0, 2, 1)               # place a * i + j is at [j, i]
        y = np.mod(m @ self.inner, PRIME) * self.turn % PRIME              # [j, k]
        return np.mod(self.outer @ y, PRIME).reshape(-1, self.n)           # [l, k] -> place b * l + k

    def backward(self, x: np.ndarray) -> np.ndarray:
        """The inverse: the same transform with the places reversed, divided by n."""
        y = self.forward(x)
        return np.mod(np.concatenate([y[:, :1], y[:, :0:-1]], axis=1) * self.scale, PRIME)


def scales(longest: int):
    """(c, s, first, last): blocks of c words every s words, for periods first .. last, up to half of ``longest``."""
    first, n = 1, 16
    while 2 * first <= longest:
        room = LEAST // 2 if first <= LEAST // 2 else first  # equal words that the shortest run of these periods leaves
        c = min(max(3 if first == 1 else 4, n // 8), LARGEST_BLOCK)
        last = first + n - c if c < LARGEST_BLOCK else 2 * first
        yield c, room - c + 1, first, last
        first, n = last + 1, 2 * n


def squared_differences(values: np.ndarray, at: np.ndarray, c: int, first: int, places: int) -> np.ndarray:
    """[block, place]: sum of squared differences, modulo PRIME, between the c values from at[block] and
    those from at[block] + first + place, for ``places`` places.  ``values`` are residues (doubles) and
    reach far enough."""
    n = 1 << int(places + c - 2).bit_length()
    t = Transform.of(n)
    block = values[at[:, None] + np.arange(c)]
    own = np.mod((block ** 2).sum(axis=1), PRIME)
    back = np.zeros((len(at), n))  # a correlation: the first value at place 0, the others back from the end
    back[:, 0] = block[:, 0]
    back[:, n - c + 1:] = block[:, :0:-1]
    window = values[at[:, None] + (first + np.arange(n))]
    total = np.concatenate([np.zeros((len(at), 1)), np.cumsum(window ** 2, axis=1)], axis=1)  # under 2**48
    squares = np.mod(total[:, c:c + places] - total[:, :places], PRIME)
    cross = t.backward(np.mod(t.forward(back) * t.forward(window), PRIME))[:, :places]
    return np.mod(own[:, None] + squares - 2 * cross, PRIME)


class Stretches:
    """Longest stretches of equal words at a distance: prefix hashes, doubling steps."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        x = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x = x * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(1)
        self.n = n
        with np.errstate(over="ignore"):
            power = np.full(n + 1, _BASE)
            power[0] = 1
            self.power = np.cumprod(power, dtype=np.uint64)
            self.sum = np.zeros(n + 1, np.uint64)
            np.cumsum(x * self.power[:n], out=self.sum[1:])

    def _equal(self, i: np.ndarray, d: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sum[i + length] - self.sum[i]) * self.power[d] == self.sum[i + d + length] - self.sum[i + d]

    def around(self, i: np.ndarray, d: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the stretch with period d around the equal places i and i + d."""
        right, left = np.zeros_like(i), np.zeros_like(i)
        step = 1 << max(0, int(longest).bit_length())
        while step:
            room = i + d + right + step <= self.n
            ok = np.flatnonzero(room)
            ok = ok[self._equal((i + right)[ok], d[ok], step)]
            right[ok] += step
            ok = np.flatnonzero(i - left - step >= 0)
            ok = ok[self._equal((i - left - step)[ok], d[ok], step)]
            left[ok] += step
            step >>= 1
        return i - left, i + d + right


def _compared(ids: np.ndarray, start: int, end: int, d: int):
    """The stretch if its words are equal d apart; else its longest true parts."""
    same = ids[start:end - d] == ids[start + d:end]
    if same.all():
        yield start, end
        return
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        yield start + a, start + b + d


def find_runs(ids: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """[run, (start, end, period)], sorted, of the texts whose words are ``ids``; text k ends before ends[k],
    where its own closing word is (which equals no other word)."""
    if not len(ends) or len(ids) < least:
        return np.zeros((0, 3), np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    longest = int((ends - starts).max())
    end_of = np.repeat(ends, np.diff(np.concatenate([starts, [ends[-1] + 1]])))  # of the text that a place belongs to
    found: dict[tuple[int, int], int] = {}
    stretches = values = None
    for c, s, first, last in scales(longest):
        at = np.arange(0, len(ids), s)
        at = at[at + first + c <= end_of[at]]
        if not len(at):
            continue
        if stretches is None:
            stretches = Stretches(ids)
            values = np.mod((ids.astype(np.uint64) * _BASE) >> np.uint64(20), np.uint64(PRIME)).astype(np.float64)
        # the furthest end of known runs with a period up to c, by their start
        cover = np.zeros(len(ids) + 1, np.int64)
        for (a, b), q in found.items():
            if q <= c:
                cover[a] = max(cover[a], b)
        cover = np.maximum.accumulate(cover)
        most = min(last - first + 1, max(2 * LARGEST_BLOCK, last - first + 1 if c < LARGEST_BLOCK else 0))
        for begin in range(first, last + 1, most):
            places = min(most, last + 1 - begin)
            n = 1 << int(places + c - 2).bit_length()
            if len(values) < len(ids) + begin + n:
                values = np.concatenate([values, np.zeros(len(ids) + begin + n - len(values))])
            few = at[at + begin + c <= end_of[at]]
            step = max(1, CELLS // n)
            for k in range(0, len(few), step):
                some = few[k:k + step]
                row, place = np.nonzero(squared_differences(values, some, c, begin, places) == 0)
                i, d = some[row], begin + place
                keep = (i + d + c <= end_of[i]) & (cover[i] < i + d + c)
                i, d = i[keep], d[keep]
                if not len(i):
                    continue
                a, b = stretches.around(i, d, longest)
                keep = b - a >= np.maximum(least, 2 * d)
                if not keep.any():
                    continue
                for a, b, d in np.unique(np.stack([a[keep], b[keep], d[keep]], axis=1), axis=0).tolist():
                    if found.get((a, b), d + 1) <= d:
                        continue
                    for x, y in _compared(ids, a, b, d):
                        if y - x >= max(least, 2 * d) and d < found.get((x, y), d + 1):
                            found[(x, y)] = d
    out = np.array([(a, b, q) for (a, b), q in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


class Texts:
    """Words of a block of texts, as pieces of their bytes; equal words have equal numbers."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        n = len(raw)
        word = ~separators[raw]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.concatenate([[False], word[:-1]]) if n else word
        after = np.concatenate([word[1:], [False]]) if n else word
        self.first = np.flatnonzero(word & (~before | cut[:n]))
        self.after = np.flatnonzero(word & (~after | cut[1:])) + 1
        self.count = np.diff(np.searchsorted(self.first, offsets))
        size = np.concatenate([[0], np.cumsum(self.after - self.first)])
        self.words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(self.first), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(raw[word])])

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the word numbers of all texts, each text followed by a number of its own."""
        own = self.words.dictionary_encode()
        k = len(own.dictionary)
        ends = np.cumsum(self.count + 1) - 1
        ids = np.empty(len(self.first) + len(self.count), np.int64)
        place = np.ones(len(ids), bool)
        place[ends] = False
        ids[place] = own.indices.to_numpy(zero_copy_only=False)
        ids[ends] = k + np.arange(len(ends))
        return ids, ends


def find(docs: DataFrame, columns: list[str] | None = None, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The chosen columns (default: all) plus n_words, runs and collapsed.

    ``runs`` is an array of (start, length, period), in words from 0, by start and period.
    ``collapsed`` is the text's words joined by one space, without those that any run holds after its
    first ``period`` words.  Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte.

    One row per input row.  Null and empty texts have no words, no runs and an empty ``collapsed``;
    texts of any length are read whole; null or repeated ids and other columns pass through; input
    columns named like the three new ones are replaced; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in (columns if columns is not None else docs.columns)
             if c.lower() not in ("n_words", "runs", "collapsed")]
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        separators = blank_separators()
        for b in batches:
            raw, offsets = text_column(b, "_text")
            for lo, hi in slices(offsets, TEXT_BYTES):
                own = offsets[lo:hi + 1] - offsets[lo]
                texts = Texts(raw[offsets[lo]:offsets[hi]], own, separators)
                ids, ends = texts.numbers()
                runs = find_runs(ids, ends, least)
                doc = np.searchsorted(ends, runs[:, 0])
                base = ends - texts.count
                table = pa.StructArray.from_arrays(
                    [pa.array(runs[:, 0] - base[doc]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])],
                    fields=list(run_type))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32()), table)
                gone = np.zeros(len(ids) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 1], -1)
                kept = np.cumsum(gone[:-1]) == 0
                kept[ends] = False
                at = np.flatnonzero(kept)
                bounds = np.searchsorted(at, np.concatenate([base, [len(ids)]]))
                at -= np.searchsorted(ends, at)  # without the closing words
                left = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), texts.words.take(pa.array(at)).cast(pa.large_string()))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(k).slice(lo, hi - lo) for k in range(len(names))], pa.array(texts.count), lists,
                     pc.binary_join(left, pa.scalar(" ", pa.large_string())).cast(pa.string())], [f"_c{k}" for k in range(len(names))] + ["n_words", "runs", "collapsed"])

    kinds = ", ".join(f"_c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(names))
    out = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(names)],
                      F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(
        run, f"{kinds}{', ' if kinds else ''}n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string")
    return out.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(names)], "n_words", "runs", "collapsed")

