"""Vectorised word, line and window hashing over Arrow text columns (NumPy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C17 & ~4 | 3          # odd, base - 1 = 2 * odd
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes outside words of ASCII letters, digits and non-ASCII characters.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i <= n, kept and doubled as needed."""
    have = _POWERS.get("p")
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << (int(n) + 1).bit_length())
        inv = pow(_BASE, -1, 1 << 64)
        for key, base in (("p", _BASE), ("i", inv)):
            out = np.full(size, U64(base))
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["p"], _POWERS["i"]


class Prefix:
    """Prefix sums of x[i] * base**i: hash of any slice in O(1)."""

    def __init__(self, x: np.ndarray):
        p, self.inv = powers(len(x))
        self.s = np.zeros(len(x) + 1, U64)
        np.cumsum(x * p[:len(x)], out=self.s[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.s[end] - self.s[start]) * self.inv[start]
                   + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    a = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset:a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words (runs of bytes outside `between`) of a chunk of texts.

    data, off: bytes and text offsets of the chunk; start, end: word bounds in
    bytes; h: 64-bit word hash; first: index of each text's first word.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, i: int, j: int, lower: bool = False,
                 between: np.ndarray = SPACE):
        self.data = data = raw[offsets[i]:offsets[j]]
        self.off = off = offsets[i:j + 1] - offsets[i]
        self.space = sp = between[data]
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], after[-1] = True, True
            before[1:], after[:-1] = sp[:-1], sp[1:]
            filled = off[:-1][off[1:] > off[:-1]]
            before[filled] = True
            after[off[1:][off[1:] > off[:-1]] - 1] = True
        word = ~sp
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.bytes = Prefix((_LOWER if lower else _BYTE)[data])
        self.h = self.bytes.of(self.start, self.end)
        self.first = np.searchsorted(self.start, off)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(j - i), self.n)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, U64), np.zeros(0, bool)
        g = Prefix(self.h).of(np.arange(n), np.arange(k, n + k))
        return g, self.doc[:n] == self.doc[k - 1:]


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the index of its leftmost least value."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, idx, span = x, np.arange(len(x)), 1
    while span * 2 <= w:
        a, b = best[:-span], best[span:]
        right = b < a
        idx = np.where(right, idx[span:], idx[:-span])
        best = np.where(right, b, a)
        span *= 2
    if span < w:
        shift = w - span
        a, b = best[:len(best) - shift], best[shift:]
        idx = np.where(b < a, idx[shift:], idx[:len(idx) - shift])
    return idx[:n]
