"""Shards from a Feistel permutation of global row numbers.

Row number ``r`` of ``n`` moves to position ``p``; its shard is ``p % shards``
and its slot ``p // shards``. Nothing is sorted or stored to shuffle: shard and
slot of a row, and the row at a shard and slot, are computed from (seed, n).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.llm.numbering import numbered

ROUNDS = 6
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1)))


def _pass(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    """One run of the balanced network over ``2 * half`` bits."""
    h, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> h, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_mix(left + key) & mask), left
        else:
            left, right = right, left ^ (_mix(right + key) & mask)
    return (left << h) | right


def permute(rows: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The positions of row numbers below ``n`` (``back``: the row numbers at positions).

    The network works on the next even number of bits; a value that falls
    outside ``n`` walks on along its cycle until it falls inside, which keeps
    the map a permutation of ``0 .. n-1``.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys, out = _keys(seed), rows.astype(np.uint64)
    with np.errstate(over="ignore"):
        out = _pass(out, half, keys, back)
        while (far := np.flatnonzero(out >= np.uint64(max(n, 1)))).size:
            out[far] = _pass(out[far], half, keys, back)
    return out.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number at a shard and slot: the inverse of ``locate``."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def position(row: Column, n: int, seed: int = 0) -> Column:
    """The position of a column of row numbers, computed in batches."""

    @F.pandas_udf("long")
    def move(r: pd.Series) -> pd.Series:
        return pd.Series(permute(r.to_numpy(), n, seed))

    return move(row)


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``row_number`` (in the order of ``order``), ``shard`` and ``slot``.

    Shard sizes differ by one row at most, slots count from 0 without a gap.
    Each row has its own place: copies of a text are not kept together. Null
    order values come first; rows equal in every order column get neighbouring
    numbers in any order. An empty table gives an empty result. Columns of ``df``
    that have the name of a new one are replaced.
    """
    rows, n = numbered(df.drop("row_number", "shard", "slot"), order)
    place = position(F.col("row_number"), n, seed)
    placed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_all"), place.alias("_p"))
    return placed.select("_all.*", (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"))
