"""Vector columns as flat arrays, and small matrices from packed rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a list column: which vectors are present with finite components only; all components as doubles; each vector's bounds in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    bounds = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.slice(bounds[0], bounds[-1] - bounds[0]) if len(column) else column.values
    bounds = bounds - bounds[0]
    values = np.asarray(pc.fill_null(flat, np.nan), dtype=np.float64)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    return np.asarray(pc.is_valid(column)) & (bad[bounds[1:]] == bad[bounds[:-1]]), values, bounds


def matrix(cells: list[bytes]) -> np.ndarray:
    """Packed double vectors as rows; shorter ones are filled with zeros."""
    out = np.zeros((len(cells), max((len(c) for c in cells), default=0) // 8))
    for i, cell in enumerate(cells):
        out[i, : len(cell) // 8] = np.frombuffer(cell, "<f8")
    return out
