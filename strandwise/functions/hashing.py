"""MurmurHash3 (x86, 32 bits) of fixed-length ASCII strings.

Spark's own ``hash`` has a fixed seed and another tail. Spelt out as columns
the function can't be kept small: filters that the optimiser infers from joins
are pushed below it and copy its expressions over and over. So it is computed
in numpy, a whole Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from strandwise.functions.dna import letters_of

_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def murmur3(rows: np.ndarray, seeds: Sequence[int]) -> np.ndarray:
    """Hashes (n x seeds, uint32) of n byte strings of one length (n x length, uint8)."""
    n, length = rows.shape
    blocks = length // 4
    padded = np.zeros((n, 4 * (blocks + 1)), np.uint8)
    padded[:, :length] = rows
    mixed = _rotated(padded.view("<u4").astype(np.uint32) * _C1, 15) * _C2
    state = np.broadcast_to(np.array(seeds, np.uint32), (n, len(seeds))).copy()
    for i in range(blocks):
        state = _rotated(state ^ mixed[:, i : i + 1], 13) * np.uint32(5) + np.uint32(0xE6546B64)
    state ^= mixed[:, blocks:]  # 0 if there is no tail
    state ^= np.uint32(length)
    state = (state ^ (state >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    state = (state ^ (state >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return state ^ (state >> np.uint32(16))


@cache
def _mixed(letters: int) -> np.ndarray:
    """What a block of so many letters, at most 4, adds to the state, by its code."""
    padded = np.zeros((4**letters, 4), np.uint8)
    padded[:, :letters] = letters_of(np.arange(4**letters), letters)
    return _rotated(padded.view("<u4")[:, 0].astype(np.uint32) * _C1, 15) * _C2


def murmur3_windows(codes: np.ndarray, k: int, seeds: Sequence[int], rows: int = 1 << 14) -> np.ndarray:
    """``murmur3`` of the windows with these codes, spelt out in ASCII: four letters at a time by table, some rows at a time."""
    out = np.empty((len(codes), len(seeds)), np.uint32)
    sizes = [4] * (k // 4) + [k % 4] * (k % 4 > 0)
    for at in range(0, len(codes), rows):
        some, left, blocks = codes[at : at + rows], 2 * k, []
        for size in sizes:
            left -= 2 * size
            blocks.append(_mixed(size)[(some >> left) & (4**size - 1)])
        high = np.empty(len(some), np.uint32)
        for s, seed in enumerate(seeds):
            state = np.full(len(some), seed, np.uint32)
            for size, block in zip(sizes, blocks):
                state ^= block
                if size == 4:
                    np.right_shift(state, 19, out=high)
                    state <<= 13
                    state |= high
                    state *= np.uint32(5)
                    state += np.uint32(0xE6546B64)
            state ^= np.uint32(k)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
                np.right_shift(state, shift, out=high)
                state ^= high
                state *= np.uint32(factor)
            out[at : at + rows, s] = state
    return out


def window_hashes(codes: np.ndarray, k: int, seeds: Sequence[int]) -> np.ndarray:
    """Hashes (n x seeds) of the windows with these codes, spelt out in ASCII."""
    return murmur3_windows(codes, k, seeds).astype(np.int64)


def with_hashes(df: DataFrame, column: str, k: int, seeds: Sequence[int], name: str = "hashes") -> DataFrame:
    """``df`` with an array column ``name``: the hash of the window ``column`` (a code, never null) for each seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = window_hashes(batch.column(column).to_numpy(), k, seeds)
            hashes = pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * len(seeds), values.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], names=[*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(LongType()))]))


def masked(value: Column, log_2_len: Column | int) -> Column:
    """The bit of a filter of 2**log_2_len bits."""
    log_2_len = F.lit(log_2_len) if isinstance(log_2_len, int) else log_2_len
    return value.bitwiseAND(F.pow(F.lit(2.0), log_2_len).cast("long") - F.lit(1))


def parse_hash_name(name: Column) -> Column:
    """The known name of a hash function, whatever its case; null for any other."""
    return F.when(F.lower(F.trim(name)).isin("murmur32", "murmur_hash_32", "murmurhash32"), F.lit("murmur32"))
