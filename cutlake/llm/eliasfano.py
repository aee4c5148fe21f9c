"""Elias-Fano sequences in flat files: monotone numbers in about ``2 + log2(range / count)`` bits each."""

from __future__ import annotations

import functools
import json
import os
import uuid
from urllib.parse import urlparse

import numpy as np

_U = np.uint64
_EACH, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: for a byte and n: the place of the byte's n-th set bit
_NTH_BIT = np.argsort(~np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"), axis=1, kind="stable").astype(_U).ravel()


def local(path: str) -> str:
    """The path of a folder that is mounted on every machine; levels are mapped from files."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"levels are memory-mapped, so the shared folder must be a mounted file system, not {path}")
    return parts.path


def save(path: str, arrays: dict[str, np.ndarray], **facts) -> None:
    """Arrays one after the other behind a line of JSON; the file appears whole."""
    path = local(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    at, index, blocks = 0, {}, []
    for name, x in arrays.items():
        data = np.ascontiguousarray(x).tobytes()
        index[name] = [at, len(x), x.dtype.str]
        blocks.append(data + b"\0" * (-len(data) % 8))
        at += len(blocks[-1])
    head = json.dumps({"index": index, **facts}).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as file:
        file.write(head)
        for block in blocks:
            file.write(block)
    os.replace(part, path)


@functools.lru_cache(maxsize=4096)
def load(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """The arrays of a file as views of its mapped pages."""
    data = np.memmap(local(path), dtype=np.uint8, mode="r")
    with open(local(path), "rb") as file:
        head = file.readline()
    facts = json.loads(head)
    views = {}
    for name, (at, n, kind) in facts["index"].items():
        size = np.dtype(kind).itemsize
        views[name] = np.asarray(data[len(head) + at : len(head) + at + n * size]).view(kind) if n else np.zeros(0, kind)
    return views, facts


def encode(x: np.ndarray, name: str) -> tuple[dict[str, np.ndarray], dict]:
    """A sorted array of whole numbers below 2**63 as low bits, unary high bits and a rank directory."""
    n = len(x)
    x = x.astype(_U)
    top = int(x[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    high = (x >> _U(low)).astype(np.int64)
    bits = np.zeros((n + (top >> low) + 1) // 64 + 2, dtype=_U)
    at = high + np.arange(n)
    np.bitwise_or.at(bits, at >> 6, _U(1) << (at & 63).astype(_U))
    lows = np.zeros((n * low) // 64 + 2, dtype=_U)
    if low:
        value, place = x & _U((1 << low) - 1), np.arange(n) * low
        word, shift = place >> 6, (place & 63).astype(_U)
        np.bitwise_or.at(lows, word, value << shift)
        over = np.flatnonzero((place & 63) + low > 64)
        np.bitwise_or.at(lows, word[over] + 1, value[over] >> (_U(64) - shift[over]))
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(bits))[:-1])).astype(np.int64)
    return {f"{name}.bits": bits, f"{name}.low": lows, f"{name}.ones": ones}, {name: [n, low]}


class Sequence:
    """Reads an encoded sequence in batches of positions or values."""

    def __init__(self, arrays: dict[str, np.ndarray], facts: dict, name: str):
        self.bits, self.lows, self.ones = (arrays[f"{name}.{x}"] for x in ("bits", "low", "ones"))
        self.n, self.low = facts[name]

    def _in_word(self, word: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The place of the ``nth`` set bit (from 0) of 64-bit words: the byte by running counts of all eight, the bit by a table."""
        sums = word - ((word >> _U(1)) & _U(0x5555555555555555))
        sums = (sums & _U(0x3333333333333333)) + ((sums >> _U(2)) & _U(0x3333333333333333))
        sums = ((sums + (sums >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH  # byte k: set bits in bytes 0..k
        nth = nth.astype(_U)
        # bytes whose running count is at most nth lie before the bit
        shift = np.bitwise_count((((nth * _EACH) | _TOPS) - sums) & _TOPS).astype(_U) << _U(3)
        before = ((sums << _U(8)) >> shift) & _U(255)
        return (shift + _NTH_BIT[((word >> shift) & _U(255)) << _U(3) | (nth - before)]).astype(np.int64)

    def _one(self, nth: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ones, nth, side="right") - 1
        return at * 64 + self._in_word(self.bits[at], nth - self.ones[at])

    @functools.cached_property
    def _zeros(self) -> np.ndarray:
        return np.arange(len(self.ones)) * 64 - self.ones

    def _zero(self, nth: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._zeros, nth, side="right") - 1
        return at * 64 + self._in_word(~self.bits[at], nth - self._zeros[at])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), _U)
        place = i * self.low
        word, shift = place >> 6, (place & 63).astype(_U)
        value = self.lows[word] >> shift
        carry = np.where(shift > 0, self.lows[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (value | carry) & _U((1 << self.low) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at positions."""
        if not len(i):
            return np.zeros(0, np.int64)
        return ((self._one(i) - i) << self.low) | self._lows(i).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The position of each value, -1 where it does not occur (values are distinct)."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        high, low = values >> self.low, (values & ((1 << self.low) - 1)).astype(_U)
        open_ = np.flatnonzero((high >= 0) & (high <= self._zeros[-1] - 1))
        high, low = high[open_], low[open_]
        # the values with high part h stand between the zeros h - 1 and h; their low bits ascend
        place = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0)
        rest = self.bits[place >> 6] >> (place & 63).astype(_U)
        run = np.bitwise_count(rest & ~(rest + _U(1))).astype(np.int64)  # ones up to the next zero of the word
        over = np.flatnonzero((place & 63) + run >= 64)  # it stands in a later word
        run[over] = self._zero(high[over]) - place[over]
        first = place - high
        last = first + run
        while len(open_):
            live = first < last
            open_, low, first, last = (x[live] for x in (open_, low, first, last))
            middle = (first + last) >> 1
            got = self._lows(middle)
            hit = got == low
            out[open_[hit]] = middle[hit]
            above = got < low
            first = np.where(above, middle + 1, np.where(hit, last, first))
            last = np.where(above, last, middle)
        return out
