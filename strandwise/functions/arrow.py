"""Texts of Arrow batches as numpy bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in cuts of about this many bytes; a longer text is a cut of its own.
CUT_BYTES = 1 << 20


def texts(column: pa.Array) -> pa.Array:
    """The column as strings with 64-bit offsets; null is read as empty."""
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of an array of ``texts``."""
    if not len(array) or array.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def cuts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of the column, some rows at a time."""
    column = texts(column)
    _, offsets = raw(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CUT_BYTES, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def pieces(batch: pa.RecordBatch, rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded size."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))
