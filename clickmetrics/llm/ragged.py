"""Rows of unequal length as one flat array and offsets (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def offsets_of(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def take(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows named by ``rows``, one after another, and their offsets."""
    lens = offsets[rows + 1] - offsets[rows]
    out = offsets_of(lens)
    place = np.arange(out[-1]) + np.repeat(offsets[rows] - out[:-1], lens)
    return values[place], out


def slices(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Spans of bytes between neighbouring offsets, as a binary Arrow array without a copy of the bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1,
                                            [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


class Growing:
    """A flat array that rows are appended to."""

    def __init__(self, dtype):
        self.buffer, self.size = np.zeros(1 << 16, dtype), 0

    def append(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.buffer):
            bigger = np.zeros(max(need, 2 * len(self.buffer)), self.buffer.dtype)
            bigger[:self.size] = self.buffer[:self.size]
            self.buffer = bigger
        self.buffer[self.size:need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.buffer[:self.size]
