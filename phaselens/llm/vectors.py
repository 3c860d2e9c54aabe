"""Vectors of Arrow list columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Rows of a batch that are made a matrix at once: bounds its memory.
MATRIX_BYTES = 32 << 20


class Vectors:
    """The vectors of a list column. A vector takes part if it is not null,
    has at least one entry, and all its entries are finite numbers."""

    def __init__(self, col: pa.Array):
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        col = col.cast(pa.large_list(col.type.value_type))
        self.offsets = col.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = col.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
        bad = np.zeros(len(self.values) + 1, dtype=np.int64)
        np.cumsum(~np.isfinite(self.values), out=bad[1:])
        self.length = np.diff(self.offsets)
        self.whole = (bad[self.offsets[1:]] == bad[self.offsets[:-1]]) & (self.length > 0)
        if col.null_count:
            self.whole &= ~col.is_null().to_numpy(zero_copy_only=False)

    def lengths(self) -> list[int]:
        return np.unique(self.length[self.whole]).tolist()

    def rows(self, length: int) -> np.ndarray:
        """Numbers of the whole vectors of a length."""
        return np.flatnonzero(self.whole & (self.length == length))

    def scaled(self, rows: np.ndarray, length: int, scale: int) -> np.ndarray:
        """floor(scale * entry) of the rows, as LONG."""
        x = np.floor(scale * self.values[self.offsets[rows][:, None] + np.arange(length)])
        if len(x) and np.abs(x).max() >= 2.0 ** 62:
            raise ValueError("a vector's entry times the scale does not fit a 64-bit integer")
        return x.astype(np.int64)

    def pieces(self, length: int):
        """The rows of a length in runs of about ``MATRIX_BYTES``."""
        rows = self.rows(length)
        step = max(1, MATRIX_BYTES // (8 * length))
        for i in range(0, len(rows), step):
            yield rows[i: i + step]
