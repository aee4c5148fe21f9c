"""Words of whole texts as offsets and hashes, without a Python object per word."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


#: Byte tables: A-Z to a-z; word bytes of the two kinds of words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BYTE = numbers(256, 7)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = (np.ones(1, dtype=_U), np.ones(1, dtype=_U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(n, base, dtype=_U)
            row[0] = 1
            both.append(np.cumprod(row, dtype=_U))
        _powers = tuple(both)
    return _powers


class Texts:
    """A slice of texts as one byte buffer; text ``i`` is ``data[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, at: int):
        self.data, self.bounds, self.at = data, bounds, at

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self, kind: np.ndarray = NOT_SPACE) -> "Words":
        return Words(self.data, self.bounds, kind)


class Words:
    """Word ``w`` is ``data[starts[w]:ends[w]]``; text ``i`` has the words ``first[i] .. first[i + 1] - 1``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind: np.ndarray):
        inside = kind[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        heads, tails = bounds[:-1], bounds[1:]
        full = heads < tails
        begin[heads[full]] = inside[heads[full]]
        end[tails[full] - 1] = inside[tails[full] - 1]
        self.kind = kind
        self.data, self.starts, self.ends = data, np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    @functools.cached_property
    def _sums(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=_U)
        np.multiply(_BYTE[self.data], _power_tables(n + 1)[0][:n], out=sums[1:])
        return np.cumsum(sums, out=sums)

    def _hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * _power_tables(len(self.data) + 1)[1][starts])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, the same for the same bytes anywhere."""
        return self._hash(self.starts, self.ends)

    def head_hashes(self, size: int) -> np.ndarray:
        """A hash of the first ``size`` bytes of each word, 0 for shorter words."""
        long = self.ends - self.starts >= size
        out = np.zeros(len(self), dtype=_U)
        out[long] = mix(self._hash(self.starts[long], self.starts[long] + size) + _U(size))
        return out


def slices(column: pa.Array, lower: bool = False, limit: int = SLICE) -> Iterator[Texts]:
    """The texts of an Arrow column (null: empty) in slices of about ``limit`` bytes.

    A slice has at least one text, whole however long it is.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
        part = bytes_[bounds[at] : bounds[to]]
        yield Texts(LOWER[part] if lower else part, bounds[at : to + 1] - bounds[at], at)
        at = to


def joined(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space between neighbours of a text, and where each starts and ends in it."""
    keep = words.kind[words.data]
    body = np.where(keep, words.data, np.uint8(0x20))
    keep[words.ends[words.ends < len(keep)]] = True
    at = np.zeros(len(keep) + 1, dtype=np.int64)
    np.cumsum(keep, out=at[1:])
    return body[keep].tobytes(), at[words.starts], at[words.ends]
