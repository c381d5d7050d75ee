"""DNA strings: windows, strands and 2-bit codes, as columns and over bytes in numpy.

A window is k letters of ACGT in either case; any other letter breaks the
sequence, so no window spans it. The canonical form of a window is the smaller
of itself and its reverse complement, so that both strands count as one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES_OF_LETTERS = ("ACGT" * 7)[:26]


def from_letters(text: Column) -> Column:
    """A DNA string for a text: letters map to bases in turn, the rest goes."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, BASES_OF_LETTERS)


def kmers(seq: Column, k: int) -> Column:
    """All windows of ``seq`` in order, as an array."""
    return F.regexp_extract_all(F.upper(seq), F.lit(f"(?=([ACGT]{{{int(k)}}}))"), F.lit(1))


def kmers_by_place(seq: Column, k: int) -> Column:
    """An array with an entry for each letter of ``seq``: the window that begins there, or the empty string."""
    return F.regexp_extract_all(F.upper(seq), F.lit(f"(?s)(?=([ACGT]{{{int(k)}}})).|."), F.lit(1))


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def encode(kmer: Column) -> Column:
    """The window as a number of 2 bits a base (k at most 31); numbers sort as the strings do."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), int(k), "0"), "0123", "ACGT")


_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
_LETTER = np.frombuffer(b"ACGT", np.uint8)


def window_codes(data: np.ndarray, offsets: np.ndarray, k: int, both_strands: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of every window of the sequences in ``data``, in order; the canonical one if both strands count as one.

    Windows double in length until they have k bases (31 at most).
    """
    base = _CODE[data]
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    broken = np.zeros(len(base) + 1, np.int32)
    np.cumsum(base == 4, out=broken[1:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero((broken[k:] == broken[:-k]) & (row[:n] == row[k - 1 :]))
    part = np.zeros(len(base) + k, np.uint64)
    part[: len(base)] = base & 3
    other = part ^ np.uint64(3)
    code, back, done, size = np.zeros(n, np.uint64), np.zeros(n, np.uint64), 0, 1
    while True:
        if k & size:
            code = (code << np.uint64(2 * size)) | part[done : done + n]
            back |= other[done : done + n] << np.uint64(2 * done)
            done += size
        if done == k:
            break
        part[:-size] = (part[:-size] << np.uint64(2 * size)) | part[size:]
        other[:-size] |= other[size:] << np.uint64(2 * size)
        size *= 2
    code = np.minimum(code, back) if both_strands else code
    return code[at].view(np.int64), row[at]


def letters_of(codes: np.ndarray, k: int) -> np.ndarray:
    """The windows of the codes as ASCII bytes (n x k)."""
    out = np.empty((len(codes), k), np.uint8)
    for i in range(k):
        out[:, i] = _LETTER[(codes >> (2 * (k - 1 - i))) & 3]
    return out
