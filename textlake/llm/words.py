"""Vectorized words of UTF-8 buffers: boundaries, 64-bit hashes and k-grams.

A word is a maximal run of bytes outside a separator set; all separators are
ASCII, so bytes and code points give the same words. A-Z is read as a-z. The
hash of a word is sum(T[byte] * P**position) modulo 2**64 with random 64-bit
T, taken from one running sum over the buffer, and then mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BLOCK = 1 << 19
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93

#: Separators: white space only, or every ASCII character but letters and digits.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[0] = 1
    return np.cumprod(p, dtype=U)


class Words:
    """Finds and hashes the words of rows laid end to end in a byte buffer."""

    def __init__(self, separators: bytes, fold_case: bool = True):
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.values = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
        if fold_case:
            self.values[65:91] = self.values[97:123]
        self.pow, self.inv = _powers(_P, BLOCK + 1), _powers(_PINV, BLOCK + 1)

    def find(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, hash and row of each word of the rows buf[offs[i]:offs[i+1]]."""
        starts, ends, hashes = [], [], []
        pos, end = int(offs[0]), int(offs[-1])
        while pos < end:
            stop = self._cut(buf, offs, pos, end)
            s, e, h = self._piece(buf[pos:stop], offs[np.searchsorted(offs, pos):np.searchsorted(offs, stop)] - pos)
            starts.append(s + pos), ends.append(e + pos), hashes.append(h)
            pos = stop
        if not starts:
            z = np.empty(0, np.int64)
            return z, z, np.empty(0, U), z
        s = np.concatenate(starts)
        return s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(offs, s, "right") - 1

    def hash_spans(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the spans b[starts[i]:ends[i]]."""
        n = len(b)
        if n >= len(self.pow):
            self.pow, self.inv = _powers(_P, n + 1), _powers(_PINV, n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(self.values[b] * self.pow[:n], dtype=U, out=total[1:])
        return mix((total[ends] - total[starts]) * self.inv[starts])

    def _cut(self, buf, offs, pos: int, end: int) -> int:
        """End of a piece of about BLOCK bytes that splits no word."""
        size = BLOCK
        while pos + size < end:
            row = int(offs[np.searchsorted(offs, pos + size, "right") - 1])
            gaps = np.flatnonzero(~self.is_word[buf[pos:pos + size]])
            cut = max(row, pos + int(gaps[-1]) + 1 if len(gaps) else pos)
            if cut > pos:
                return cut
            size *= 2
        return end

    def _piece(self, b: np.ndarray, rows: np.ndarray):
        n = len(b)
        w = self.is_word[b]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        rows = rows[rows < n]
        first[rows] |= w[rows]
        before = rows[rows > 0] - 1
        last[before] |= w[before]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        return s, e, self.hash_spans(b, s, e)


def kgrams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words, and whether the k words lie in one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, bool)
    out, q = np.zeros(n, U), 1
    for j in range(k):
        out += h[j:j + n] * U(q)
        q = q * _Q % (1 << 64)
    return mix(out), row[:n] == row[k - 1:]


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole short word sequence, as kgrams() of its own length."""
    return int(kgrams(h, np.zeros(len(h), np.int64), len(h))[0][0])
