"""Counting quotient filters of packed n-grams: invertible permutation, quotient runs, full remainders, exact counters."""

from __future__ import annotations

import functools
import struct

import numpy as np

from cutlake.llm.words import mix

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_HEAD = struct.Struct("<QBBQ")
Lanes = list[np.ndarray]


class Layout:
    """``n`` word ids of ``bits`` bits in lanes of at most 64 bits; no id is split."""

    def __init__(self, n: int, bits: int):
        self.n, self.bits, self.each = n, bits, 64 // bits
        self.sizes = [min(self.each, n - i) for i in range(0, n, self.each)]
        self.widths = [s * bits for s in self.sizes]

    def pack(self, words: list[np.ndarray]) -> Lanes:
        """The ``n`` columns of ids as permuted lanes."""
        lanes, at = [], 0
        for size in self.sizes:
            lane = np.zeros(len(words[0]), _U)
            for word in words[at : at + size]:
                lane = lane << _U(self.bits) | word.astype(_U)
            lanes.append(lane)
            at += size
        return self._turned(lanes)

    def unpack(self, lanes: Lanes) -> list[np.ndarray]:
        out = []
        for lane, size in zip(self._returned(lanes), self.sizes):
            out += [lane >> _U(self.bits * (size - 1 - i)) & _U((1 << self.bits) - 1) for i in range(size)]
        return out

    def _key(self, lanes: Lanes) -> np.ndarray:
        return functools.reduce(lambda held, lane: mix(held ^ lane), lanes[1:], np.full(len(lanes[0]), 7, _U))

    def _turned(self, lanes: Lanes) -> Lanes:
        # the first lane, from which quotients are cut, depends on all of them
        mask = _U((1 << self.widths[0]) - 1)
        return [_spread((lanes[0] ^ self._key(lanes)) & mask, self.widths[0]), *lanes[1:]]

    def _returned(self, lanes: Lanes) -> Lanes:
        mask = _U((1 << self.widths[0]) - 1)
        return [(_gathered(lanes[0], self.widths[0]) ^ self._key(lanes)) & mask, *lanes[1:]]


def _spread(x: np.ndarray, width: int, rounds: int = 3) -> np.ndarray:
    """A bijection of ``width``-bit numbers that spreads every bit over all bits."""
    mask, half = _U((1 << width) - 1), _U((width + 1) // 2)
    for _ in range(rounds):
        x = (x * _U(_ODD)) & mask
        x = x ^ (x >> half)
    return x


def _gathered(x: np.ndarray, width: int, rounds: int = 3) -> np.ndarray:
    mask, half, back = _U((1 << width) - 1), _U((width + 1) // 2), _U(pow(_ODD, -1, 1 << 64))
    for _ in range(rounds):
        x = x ^ (x >> half)
        x = (x * back) & mask
    return x


def added(lanes: Lanes, counts: np.ndarray | None = None) -> tuple[Lanes, np.ndarray]:
    """Equal keys as one with their counts added up (each key 1 without ``counts``), in key order.

    Sorted inputs one after another are runs that the stable sort merges.
    """
    if not len(lanes[0]):
        return lanes, np.zeros(0, np.int64)
    if len(lanes) == 1 and counts is None:
        keys = np.sort(lanes[0])
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return [keys[start]], np.diff(np.append(start, len(keys)))
    order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
    lanes = [lane[order] for lane in lanes]
    new = np.concatenate(([True], np.logical_or.reduce([lane[1:] != lane[:-1] for lane in lanes])))
    start = np.flatnonzero(new)
    if counts is None:
        return [lane[start] for lane in lanes], np.diff(np.append(start, len(order)))
    return [lane[start] for lane in lanes], np.add.reduceat(counts[order], start)


def contained(lanes: Lanes, among: Lanes) -> np.ndarray:
    """Which keys are in the sorted keys ``among``."""
    found = np.zeros(len(lanes[0]), bool)
    if not len(among[0]):
        return found
    at, last = np.searchsorted(among[0], lanes[0]), len(among[0]) - 1
    runs = np.flatnonzero(np.concatenate(([True], among[0][1:] != among[0][:-1], [True])))
    for step in range(int(np.diff(runs).max())):
        place = np.minimum(at + step, last)
        found |= np.logical_and.reduce([a[place] == k for a, k in zip(among, lanes)])
    return found


def _bytes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each number, byte plane by byte plane."""
    n = -(-width // 8)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _numbers(data: memoryview, n: int, width: int) -> tuple[np.ndarray, memoryview]:
    planes = -(-width // 8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :planes] = np.frombuffer(data[: n * planes], np.uint8).reshape(planes, n).T
    return wide.reshape(-1).view("<u8").astype(_U), data[n * planes :]


def encode(layout: Layout, lanes: Lanes, counts: np.ndarray, shard_bits: int) -> bytes:
    """The filter of sorted keys that agree in their first ``shard_bits`` bits.

    A key's quotient (about as many values as keys) is held by the run that it lies in:
    one bit a key and one a quotient. The remainder is stored in full, the count in
    a byte; larger counts follow as 64-bit numbers.
    """
    n, width = len(counts), layout.widths[0] - shard_bits
    bits = min(width, max(0, n.bit_length() - 1), 40)
    own = lanes[0] & _U((1 << width) - 1) if width else np.zeros(n, _U)
    runs = np.zeros(n + (1 << bits), bool)
    runs[(own >> _U(width - bits)).astype(np.int64) + np.arange(n)] = True
    large = counts >= 255
    parts = [_HEAD.pack(n, bits, shard_bits, int(lanes[0][0] >> _U(width)) if n and width < 64 else 0), np.packbits(runs).tobytes(), _bytes(own, width - bits) if width > bits else b""]
    parts += [_bytes(lane, w) for lane, w in zip(lanes[1:], layout.widths[1:])]
    return b"".join([*parts, np.where(large, 255, counts).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()])


def decode(layout: Layout, data: bytes) -> tuple[Lanes, np.ndarray]:
    n, bits, shard_bits, shard = _HEAD.unpack_from(data)
    view, width = memoryview(data)[_HEAD.size :], layout.widths[0] - shard_bits
    size = -(-(n + (1 << bits)) // 8)
    runs = np.unpackbits(np.frombuffer(view[:size], np.uint8), count=n + (1 << bits)).astype(bool)
    view = view[size:]
    first = (np.flatnonzero(runs) - np.arange(n)).astype(_U) << _U(width - bits)
    if width > bits:
        low, view = _numbers(view, n, width - bits)
        first |= low & _U((1 << (width - bits)) - 1)
    if shard_bits:
        first |= _U(shard << width)
    lanes = [first]
    for w in layout.widths[1:]:
        lane, view = _numbers(view, n, w)
        lanes.append(lane)
    counts = np.frombuffer(view[:n], np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(view[n:], "<i8")
    return lanes, counts


def shards(layout: Layout, lanes: Lanes, counts: np.ndarray, bits: int):
    """``(shard, filter)`` of sorted keys, cut by the first ``bits`` bits (fewer where the first lane is shorter)."""
    bits = min(bits, layout.widths[0] - 1)
    top = (lanes[0] >> _U(layout.widths[0] - bits)).astype(np.int64) if bits else np.zeros(len(counts), np.int64)
    cut = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1], [True]))) if len(top) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(top[a]), encode(layout, [lane[a:b] for lane in lanes], counts[a:b], bits)


def merged(layout: Layout, filters, held: int = 1 << 20) -> tuple[Lanes, np.ndarray]:
    """Filters of one shard as one, counts added up; about ``held`` keys more than the result holds are decoded at once."""
    lanes, counts, waiting, size = [np.zeros(0, _U) for _ in layout.widths], np.zeros(0, np.int64), [], 0
    for data in [*filters, None]:
        if data is not None:
            waiting.append(decode(layout, data))
            size += len(waiting[-1][1])
        if waiting and (data is None or size > max(held, len(counts))):
            lanes, counts = added([np.concatenate(x) for x in zip(lanes, *(w[0] for w in waiting))], np.concatenate([counts, *(w[1] for w in waiting)]))
            waiting, size = [], 0
    return lanes, counts
