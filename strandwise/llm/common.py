"""What the operators share: Arrow text slices, vectorised tokens and hashes, and keyed filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.operators.common import BROADCAST_BYTES, small_side  # noqa: F401
from strandwise.session import discard, materialize, table  # noqa: F401

#: Texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def word_mask(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to words: ASCII letters and digits and what lies beyond ASCII.

    Blanks and punctuation beyond ASCII (no-break spaces, curly quotes, dashes,
    ellipses, those of CJK scripts) belong to none, like those of ASCII.
    """
    return WORD_BYTE[data] & ~sign_mask(data)


def sign_mask(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text are blanks or punctuation beyond ASCII."""
    signs = np.zeros(len(data), bool)
    leads = np.flatnonzero(data >= 0xC2)
    kinds = data[leads]
    for lead, second, third in _SIGNS:
        at = leads[kinds == lead]
        at = at[second[data[at + 1]]]
        if third is not None:
            at = at[third[data[at + 2]]]
            signs[at + 2] = True
        signs[at] = signs[at + 1] = True
    return signs


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: (first byte, second bytes, third bytes or None) of the signs beyond ASCII.
_SIGNS = [
    (0xC2, _bytes((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF)), None),  # Latin-1 but for letters
    (0xE2, _bytes((0x80, 0x80), (0x81, 0x81)), _bytes((0x80, 0xBF))),  # general punctuation
    (0xE3, _bytes((0x80, 0x80)), _bytes((0x80, 0x84), (0x87, 0xA0), (0xB0, 0xB0))),  # CJK punctuation
    (0xEF, _bytes((0xBC, 0xBC)), _bytes((0x80, 0x8F), (0x9A, 0xA0), (0xBB, 0xBF))),  # full-width signs
    (0xEF, _bytes((0xBD, 0xBD)), _bytes((0x80, 0x80), (0x9B, 0xA5))),
]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 1)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        _powers[base] = got = np.multiply.accumulate(got)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit Karp-Rabin hash of each span data[start:end]; equal bytes give equal hashes."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=prefix[1:])
    inverse = powers(_BASE_INVERSE, len(data) + 1)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def strings(batch: pa.RecordBatch | pa.Table, column: str) -> pa.Array:
    """The column as Arrow strings with 64-bit offsets; null is read as empty."""
    array = batch.column(column)
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    return pc.fill_null(array, "") if array.null_count else array


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of an array of large strings."""
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    if array.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch cut by bytes of text, with the text column of each cut."""
    texts = strings(batch, column)
    _, offsets = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of bytes marked in the table ``inside``; none crosses a row."""
    return runs(inside[data], offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words of lower-cased texts; in scripts without blanks (CJK) every character is one."""
    inside = word_mask(data)
    return runs(inside, offsets, np.flatnonzero((data >= 0xE3) & (data <= 0xE9) & inside))


def runs(is_in: np.ndarray, offsets: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of marked bytes; none crosses a row.

    ``alone``: places of marked three-byte characters that are runs of their own.
    """
    if not len(is_in):
        none = np.zeros(0, np.int64)
        return none, none, none
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge = is_in.copy()
    edge[1:] &= ~is_in[:-1]
    edge[filled] = is_in[filled]
    if alone is not None and len(alone):
        later = alone[alone + 3 < len(edge)] + 3
        edge[alone] = True
        edge[later] |= is_in[later]
    starts = np.flatnonzero(edge)
    edge = is_in.copy()
    edge[:-1] &= ~is_in[1:]
    edge[filled[1:] - 1] = is_in[filled[1:] - 1]
    edge[-1] = is_in[-1]
    if alone is not None and len(alone):
        before = alone[alone > 0] - 1
        edge[alone + 2] = True
        edge[before] |= is_in[before]
    ends = np.flatnonzero(edge) + 1
    bounds = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return starts, ends, rows


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not in ``ids``; rows without a key stay."""
    return docs.join(small_side(ids.select(key)), key, "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that helper columns can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])
