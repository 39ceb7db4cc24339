"""Numpy views of Arrow text columns, shared by the operators that work on bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, "uint8"), np.zeros(1, "int64")
    _, off, data = column.buffers()
    off = np.frombuffer(off, "<i8")[column.offset : column.offset + len(column) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, "uint8"), off - off[0]
    return np.frombuffer(data, "uint8")[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, most: int):
    """(first, end) row ranges of about ``most`` bytes; a longer row is a run of its own."""
    first, n = 0, len(off) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield first, end
        first = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def random_words(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers by rule."""
    return mixed(np.arange(1, n + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
