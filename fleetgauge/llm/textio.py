"""Texts of Arrow columns as byte buffers, a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def byte_pieces(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and end of each text, for runs of rows of at most about ``limit`` bytes (one row at least).

    Null texts are empty.
    """
    raw = column.cast(pa.large_binary()).fill_null(b"")
    if not len(raw):
        return
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(raw):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1)
        yield row, stop, whole[bounds[row] : bounds[stop]], bounds[row + 1 : stop + 1] - bounds[row]
        row = stop
