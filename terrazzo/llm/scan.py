"""Whole texts as byte arrays: word and line spans and their 64-bit hashes, computed with NumPy.

Texts are handled in slices of a few hundred kilobytes, so memory does not grow with a batch.
A hash of a span depends only on its bytes, never on the process, so tasks agree on it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np

SLICE = 400_000  # bytes handled at a time; a longer text is a slice of its own
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True  # the white space of the contracts: [\x20\x09-\x0D]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only

_pow = (np.ones(1, _U), np.ones(1, _U))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if len(_pow[0]) < n:
        size = max(n, SLICE + 1024)
        made = []
        for base in (_P, _P_INV):
            x = np.full(size, base, _U)
            x[0] = 1
            made.append(np.cumprod(x, dtype=_U))
        if size > 16 * SLICE:  # one huge text: do not keep its tables
            return made[0], made[1]
        _pow = (made[0], made[1])
    return _pow


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public SplitMix64 constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix(codes: np.ndarray) -> np.ndarray:
    """Running sums of code * P**position modulo 2**64; prefix[i] covers codes[:i]."""
    out = np.zeros(len(codes) + 1, _U)
    np.cumsum((codes.astype(_U) + _U(1)) * _powers(len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), equal for equal contents wherever they stand."""
    inverse = _powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def slices(texts: Sequence[bytes], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about `limit` bytes together."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > limit:
            yield at, i
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


class Joined:
    """Consecutive texts as one byte array, each followed by a line feed."""

    def __init__(self, texts: Sequence[bytes], lower: bool = False):
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.n = len(texts)
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]
        self.start = np.cumsum(sizes + 1) - sizes - 1
        self.end = self.start + sizes
        self._sums: np.ndarray | None = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = prefix(self.bytes)
        return self._sums

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and `first`: words of text i are first[i]:first[i + 1]."""
        word = np.empty(len(self.bytes) + 1, bool)
        word[0] = False
        np.logical_not(SPACE[self.bytes], out=word[1:])
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, end = edge[::2], edge[1::2]  # the last byte is white space, so edges pair up
        return start, end, np.append(np.searchsorted(start, self.start), len(start))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all lines (without the line feed), and `first` as for words."""
        end = np.flatnonzero(self.bytes == 10)
        start = np.concatenate(([0], end[:-1] + 1))
        return start, end, np.append(np.searchsorted(start, self.start), len(start))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hash(self.sums, start, end)


_PRINT = mix(np.arange(256, dtype=_U) + _U(0x3C6EF372FE94F82B))


def fingerprints(joined: Joined, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second 64-bit hash of spans, independent of the first."""
    return span_hash(prefix(_PRINT[joined.bytes]), start, end)


def owner(first: np.ndarray) -> np.ndarray:
    """For each word or line the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


_SHINGLE = [_U(pow(0xA24BAED4963EE407, k, 1 << 64)) for k in range(1, 65)]


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all `width`-word windows, each window's first word, and `first` of windows by text.

    A text of fewer words than `width` has one window, all its words; a text without words has none.
    """
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.concatenate(([0], np.cumsum(counts)))
    at = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    size = np.repeat(np.minimum(n, width), counts)
    h = np.zeros(len(at), _U)
    padded = np.concatenate((words, np.zeros(width, _U)))
    for k in range(width):
        h += np.where(k < size, padded[at + k], _U(0)) * _SHINGLE[k]
    return mix(h + size.astype(_U)), at, begin


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null is an empty text."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


_holders: list = []


def register_cache(clear) -> None:
    """A worker outlives its tasks; `clear` empties a table that only one operator's tasks need."""
    _holders.append(clear)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def release() -> None:
    """Empties the tables that another operator left in this worker."""
    if any([clear() for clear in _holders]):
        trim()


def text_slices(column, limit: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) for consecutive slices of an Arrow string column."""
    release()
    texts = utf8(column)
    for a, b in slices(texts, limit):
        yield a, texts[a:b]
    del texts
    trim()
