"""Words and their 64-bit hashes from many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_M = (1 << 64) - 1
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
#: Bytes of text worked on at once; one longer text is a piece of its own.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93
_POWERS = [np.cumprod(np.full(64, BASE, np.uint64))]


def _powers(n: int) -> np.ndarray:
    if n > len(_POWERS[0]):
        _POWERS[0] = np.cumprod(np.full(max(n, 4096), BASE, np.uint64))
    return _POWERS[0]


class Piece:
    """Words of the texts first..last-1: start and end (bytes in buf), hash, and per text the range of its words in ``of``."""

    def __init__(self, first: int, texts: list[bytes], separators: np.ndarray):
        self.first = first
        self.buf = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.begin = np.concatenate([[0], np.cumsum(lengths)])
        gap = separators[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = self._hashes(gap)
        self.of = np.searchsorted(self.start, self.begin)

    def _hashes(self, gap: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.flatnonzero(~gap)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        value = BYTE[self.buf[at]]
        value *= _powers(int(size.max()))[np.arange(len(at)) - np.repeat(first, size)]
        return mix(np.add.reduceat(value, first) + size.astype(np.uint64))

    def __len__(self) -> int:
        return len(self.begin) - 1


def pieces(texts, separators: np.ndarray = SPACES, most: int = PIECE) -> Iterator[Piece]:
    """Texts (str or None) in order, in pieces of about ``most`` bytes; every text whole."""
    part: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if part and size + len(raw) > most:
            yield Piece(first, part, separators)
            part, first, size = [], i, 0
        part.append(raw)
        size += len(raw)
    if part:
        yield Piece(first, part, separators)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : len(hashes) - n + 1 + j]
    return mix(out)


def counts_of(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def lcs_bits(item: list[int], text: Iterable[int]) -> int:
    """Length of the longest common subsequence; a bit of an int per word of item."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        u = v & where.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()
