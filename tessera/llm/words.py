"""Words of whole texts, split and hashed as numpy arrays.

A word is a run of characters other than the space and U+0009 to U+000D, as in ``[^\\x20\\x09-\\x0D]+``.  All of them are
single bytes in UTF-8, so texts are split as bytes, many texts at a time, without a Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text that are worked on at a time; one longer text is one piece.
PIECE_BYTES = 1 << 20

#: Odd constants that set apart seeds, places and lengths.
_STEP, _LINK = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: Masks that keep the first bytes of eight.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the len + 1 offsets of texts in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_string(texts.type) and not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(at, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def trim() -> None:
    """Give back what the allocator keeps of large arrays that have come and gone."""
    if _trim is not None:
        _trim(0)


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first text, texts) with at most so many bytes, one text at least."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    lo = 0
    while lo < len(texts):
        done = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi
    trim()


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of texts in data
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    first: np.ndarray  # words first[i]:first[i + 1] are those of text i
    inside: np.ndarray  # per byte: is in a word

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.first.size - 1), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; different seeds give independent ones."""
        return span_hashes(self.data, self.starts, self.ends, seed)

    def strings(self, i: int) -> list[bytes]:
        """The words of text i."""
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().split()


def split(texts: pa.Array) -> Words:
    data, off = raw(texts)
    inside = ~SEPARATORS[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    at, to = off[:-1][full], off[1:][full] - 1
    begins[at], stops[to] = inside[at], inside[to]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(data, off, starts, ends, np.searchsorted(starts, off), inside)


def eights(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as integers; those beyond `left` are zero."""
    whole = np.zeros((data.size + 23) // 8, U64)
    whole.view(np.uint8)[: data.size] = data
    low, shift = at >> 3, ((at & 7) << 3).astype(U64)
    out = whole[low] >> shift
    out |= (whole[low + 1] << (U64(63) - shift)) << U64(1)
    out &= _FIRST[np.minimum(left, 8)]
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes: its blocks of eight are mixed, each with its place and the seed, and then summed and mixed with the length.

    Every block goes through a function that is not linear before it is added, so no arrangement of few letters cancels out, as it does in polynomials.
    """
    lens = ends - starts
    if not lens.size:
        return np.zeros(0, U64)
    n = np.maximum((lens + 7) >> 3, 1)
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum()))
    place -= np.repeat(first, n)
    x = eights(data, np.repeat(starts, n) + 8 * place, np.repeat(lens, n) - 8 * place)
    keys = mix((np.arange(int(n.max()), dtype=U64) + U64(1)) * _STEP + U64(seed))
    x ^= keys[place]
    return mix(np.add.reduceat(mix(x), first) + lens.astype(U64) * _LINK)


def link(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, one after the other."""
    return mix(a * _LINK + b)


class Runs:
    """Hashes of runs of neighbouring values by doubling: those of 1, 2, 4, ... values, each made of two of half the length.

    Any run is its first part and its last part, each the longest power of two that it holds.  The caller leaves out runs over two texts.
    """

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def _level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(link(last[:-step], last[step:]) if last.size > step else last[:0])
        return self.levels[j]

    def all(self, k: int) -> np.ndarray:
        """A hash of each run of k values; fewer than k values have none."""
        n = self.levels[0].size - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        j = k.bit_length() - 1
        level = self._level(j)
        return level[:n] if k == 1 << j else link(level[:n], level[k - (1 << j) :][:n] + U64(k))

    def some(self, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A hash of each run of n[i] values from lo[i] on."""
        out = np.zeros(lo.size, U64)
        power = np.frexp(n.astype(float))[1] - 1
        for j in np.unique(power):
            own = np.flatnonzero(power == j)
            a, size, level = lo[own], n[own], self._level(int(j))
            out[own] = np.where(size == 1 << j, level[a], link(level[a], level[a + size - (1 << j)] + size.astype(U64)))
        return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k neighbouring values."""
    return Runs(hashes).all(k)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
