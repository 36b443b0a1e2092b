"""Hashes of words and word shingles of many texts at once, in numpy.

A word's hash is a polynomial in its bytes (random value of each byte, mod 2^64), got for all words from one
running sum: (sum up to its end - sum up to its start) times the inverse power of its start.  It is then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import text_buffers

_RANDOM = np.random.Generator(np.random.PCG64(20_240_817))
_BASE = int(_RANDOM.integers(1 << 61)) * 8 + 5  # odd, of large order
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = _RANDOM.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT = _VALUES.copy()
#: Upper-case ASCII letters count as lower-case ones.
_VALUES[0x41:0x5B] = _VALUES[0x61:0x7B]
_PLACES = _RANDOM.integers(1 << 63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII characters that aren't letters; all other bytes belong to words.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = -(-n // 65536) * 65536
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, np.uint64(b))
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Words:
    """Where the words of a batch of texts are (start, end: byte places; doc: number of text) and, asked for, hashes (folded: without regard to case)."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACES, folded: bool = True):
        self.values = _VALUES if folded else _EXACT
        self.data, self.offsets = text_buffers(texts)
        n = len(self.data)
        word = ~separators[self.data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        begins = self.offsets[:-1]
        begins = begins[begins < n]
        first[begins] = word[begins]
        last = word.copy()
        last[:-1] &= ~word[1:]
        ends = self.offsets[1:]
        ends = ends[ends > 0] - 1
        last[ends] = word[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Number of the first word of each text, with the end last.
        self.of = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.of))
        self._sum: np.ndarray | None = None

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Of all words, or of any stretches of bytes."""
        start, end = (self.start, self.end) if start is None else (start, end)
        up, down = powers(len(self.data) + 1)
        if self._sum is None:
            self._sum = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(self.values[self.data] * up[: len(self.data)], out=self._sum[1:])
        return mixed((self._sum[end] - self._sum[start]) * down[start])


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's shingles of `size` words in order, repeats too; where each text's begin, with the end last.

    Fewer words make one shingle of them all; no word, none.
    """
    words = Words(texts)
    h = words.hashes()
    count = np.diff(words.of)
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        out += h[j : j + len(out)] * _PLACES[j]
    out = mixed(out + np.uint64(size))
    number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(number)])
    where = np.repeat(words.of[:-1] - bounds[:-1], number) + np.arange(bounds[-1])
    got = np.zeros(bounds[-1], np.uint64)
    inside = where < len(out)
    got[inside] = out[where[inside]]
    for i in np.flatnonzero((count > 0) & (count < size)):
        own = h[words.of[i] : words.of[i + 1]]
        got[bounds[i]] = mixed((own * _PLACES[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return got, bounds


def sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    h, bounds = shingles(texts, size)
    return [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def set_hash(own: np.ndarray) -> bytes:
    """A hash of a whole set: two 64-bit sums and its size."""
    two = np.array([mixed(own).sum(dtype=np.uint64), mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
    return two.tobytes() + len(own).to_bytes(8, "little")
