"""Words of whole texts as 64-bit hashes, straight from Arrow buffers with numpy.

A prefix sum of byte * P**i (modulo 2**64) gives the polynomial hash of any
byte range as a difference, so all words of a batch are hashed without a
Python loop.  The value is mixed with the word's length and finalised.
"""

from __future__ import annotations

import numpy as np

from .common import slices

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
SEGMENT = 1 << 18
_U = np.uint64


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def blank_separators() -> np.ndarray:
    """Separators of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.zeros(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = True
    return t


def alnum_separators() -> np.ndarray:
    """Separators of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (after lower-casing)."""
    t = np.zeros(256, bool)
    t[0x00:0x30] = t[0x3A:0x61] = t[0x7B:0x80] = True
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values (a bijection)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs of one text; order counts."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out) + h[k: len(h) - n + 1 + k]
    return mix(out)


class Hasher:
    """Word hashes of a batch of texts.  ``separators`` and ``lower`` are 256-entry tables."""

    def __init__(self, separators: np.ndarray, lower: np.ndarray | None = None):
        self.lower = lower_table() if lower is None else lower
        self.sep = separators[self.lower]
        self._grow(SEGMENT)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            p = np.full(n + 1, _P, _U)
            p[0] = 1
            q = np.full(n + 1, _PINV, _U)
            q[0] = 1
            self.pw, self.inv = np.cumprod(p, dtype=_U), np.cumprod(q, dtype=_U)

    def _segment(self, raw: np.ndarray, starts: np.ndarray):
        """(start, length, hash) of every word; a word also ends where a text of ``starts`` begins."""
        n = len(raw)
        if n >= len(self.pw):
            self._grow(n)
        word = ~self.sep[raw]
        cut = np.zeros(n + 1, bool)
        cut[starts] = True
        cut[n] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = word[:-1]
        first = np.flatnonzero(word & (~before | cut[:n]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = word[1:]
        last = np.flatnonzero(word & (~after | cut[1:]))
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, _U)
            total[0] = 0
            np.cumsum((self.lower[raw].astype(_U) + _U(1)) * self.pw[:n], out=total[1:])
            length = last - first + 1
            h = (total[last + 1] - total[first]) * self.inv[first]
            return first, length, mix(h ^ (length.astype(_U) * _U(0xD6E8FEB86659FD93)))

    def words(self, raw: np.ndarray, offsets: np.ndarray):
        """Yield (a, b, bounds, hashes): rows [a, b) of the batch, word hashes of all their texts
        in order, and ``bounds`` (b - a + 1 offsets into the hashes).  Working memory follows
        SEGMENT, not the length of a text: longer texts are cut between words."""
        for a, b in slices(offsets, SEGMENT):
            lo, hi = int(offsets[a]), int(offsets[b])
            if hi - lo <= SEGMENT:
                if hi == lo:
                    yield a, b, np.zeros(b - a + 1, np.int64), np.zeros(0, _U)
                    continue
                rel = offsets[a:b + 1] - lo
                first, _, h = self._segment(raw[lo:hi], rel[:-1][rel[:-1] < hi - lo])
                yield a, b, np.searchsorted(first, rel), h
                continue
            parts, at = [], lo  # one long text
            while at < hi:
                end = min(at + SEGMENT, hi)
                while end < hi:  # to the next separator
                    stop = np.flatnonzero(self.sep[raw[end:end + SEGMENT]])
                    end = min(end + (int(stop[0]) if len(stop) else SEGMENT), hi)
                    if len(stop):
                        break
                parts.append(self._segment(raw[at:end], np.zeros(1, np.int64))[2])
                at = end
            h = np.concatenate(parts)
            yield a, b, np.array([0, len(h)], np.int64), h
