"""Sizes and error rates of Bloom filters, as columns and driver scalars."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = range(1, 6)
LOG_LEN = (18, 32)
FALSE_POSITIVE = 0.25
COUNT_FALSE_POSITIVE = 0.01
FILTERS_PER_FILE = 2048
FILE_BITS = 8 << 36


def false_positive(n_kmers: Column, log_2_len: Column, n_hashes: Column) -> Column:
    """Probability that a filter answers yes for a window it doesn't hold."""
    length = F.pow(F.lit(2.0), log_2_len)
    return F.pow(1 - F.pow(1 - 1 / length, (n_kmers * n_hashes).cast("double")), n_hashes.cast("double"))


def bloom_params(df: DataFrame, n_kmers: str = "n_kmers", p: float = FALSE_POSITIVE, shortest: int = LOG_LEN[0], longest: int = LOG_LEN[1]) -> DataFrame:
    """``df`` with log_2_filter_len and num_hash; null where no filter does (no windows, or too many).

    The shortest filter for which some number of hashes meets ``p``; among its
    numbers of hashes the one of the least error, the smaller of equal ones.
    ``p`` is a single-precision number.
    """
    limit = struct.unpack("f", struct.pack("f", p))[0]
    n = F.col(f"`{n_kmers}`")
    grid = F.array(*[F.struct(F.lit(size).alias("size"), F.lit(h).alias("h")) for size in range(shortest, longest + 1) for h in HASHES])
    ways = F.transform(grid, lambda g: F.struct(g["size"].alias("size"), false_positive(n, g["size"], g["h"]).alias("p"), g["h"].alias("h")))
    # structs compare by size, then by error, then by number of hashes
    best = F.array_min(F.filter(ways, lambda w: w["p"] <= F.lit(limit)))
    some = n > 0
    return df.withColumn("log_2_filter_len", F.when(some, best["size"])).withColumn("num_hash", F.when(some, best["h"]))


def most_kmers(p: float = FALSE_POSITIVE, shortest: int = LOG_LEN[0], longest: int = LOG_LEN[1]) -> int:
    """The first power of two for which no filter meets ``p``."""
    p = struct.unpack("f", struct.pack("f", p))[0]
    for j in range(1, 64):
        if not any((1 - (1 - 1 / 2.0**size) ** float((1 << j) * h)) ** h <= p for size in range(shortest, longest + 1) for h in HASHES):
            return 1 << j
    return (1 << 64) - 1


def counting_filter_log_len(n_bases: Column) -> Column:
    """Length of a counting filter (log 2) for so many bases, within its limits; the longest where it is unknown."""
    inner = 1 - COUNT_FALSE_POSITIVE**0.25
    size = F.ceil(F.ln(1 / (1 - F.pow(F.lit(inner), 1 / (2 * n_bases).cast("double")))) / F.lit(math.log(2.0)))
    return F.when(n_bases > 0, F.greatest(F.lit(18), F.least(F.lit(32), size)).cast("int")).otherwise(F.lit(32))


def deflation(log_2_len: Column, n_bases: Column) -> Column:
    """Bits of a filter over the bits of its run at two a base; 0 for a run without bases."""
    return F.when(n_bases > 0, F.pow(F.lit(2.0), log_2_len) / (2 * n_bases)).otherwise(F.lit(0.0))


def filters_per_file(log_2_len: Column) -> Column:
    """How many filters of a length go into one file."""
    return F.least(F.lit(FILTERS_PER_FILE).cast("long"), (F.lit(float(FILE_BITS)) / F.pow(F.lit(2.0), log_2_len)).cast("long"))
