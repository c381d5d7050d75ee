"""K-mer tables: windows, distinct sets, counts, profiles and read filters.

Sequences come as (id, seq); null and short sequences have no windows. A window
is kept as its 2-bit code, a number, in all operators (``dna.decode`` spells it
out), so that shuffles carry 8 bytes a window; codes sort as the strings do.
Windows are cut in numpy, an Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from strandwise.functions import dna
from strandwise.functions.arrow import cuts, pieces, raw
from strandwise.operators.common import small_side

LONGEST_WINDOW = 31
#: The rows of a sequence that comes in several are joined if they have this many letters at most; those of a longer one never meet in a task.
JOINED_LETTERS = 1 << 22
SUMMARY = ["n_bases", "n_kmers", "n_distinct", "least", "most"]


def _check(k: int) -> None:
    if not 1 <= k <= LONGEST_WINDOW:
        raise ValueError(f"a window has 1 to {LONGEST_WINDOW} bases")


def windows(seqs: DataFrame, k: int, canonical: bool = True, with_length: bool = False) -> DataFrame:
    """(id, kmer) of every window.

    With ``with_length``, (id, kmer, n) with n = 1, and for each sequence a row
    with a null window and n = its number of letters.
    """
    _check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in cuts(batch.column("seq")):
                data, offsets = raw(texts)
                codes, row = dna.window_codes(data, offsets, k, canonical)
                columns, names = [batch.column("id").take(pa.array(row + first)), pa.array(codes)], ["id", "kmer"]
                if with_length:
                    columns, names = [*columns, pa.array(np.ones(len(codes), np.int64))], [*names, "n"]
                    own = batch.slice(first, len(texts)).column("id")
                    yield pa.RecordBatch.from_arrays([own, pa.nulls(len(own), pa.int64()), pa.array(np.diff(offsets))], names=names)
                yield from pieces(pa.RecordBatch.from_arrays(columns, names=names))

    fields = [seqs.schema["id"], StructField("kmer", LongType()), *[StructField("n", LongType())] * with_length]
    return seqs.select("id", "seq").mapInArrow(run, StructType(fields))


def positions(seqs: DataFrame, k: int) -> DataFrame:
    """(id, pos, kmer): every window, spelt out, with the place where it begins, from 0 on."""
    rows = seqs.select("id", F.posexplode(dna.kmers_by_place(F.col("seq"), k)).alias("pos", "kmer"))
    return rows.where("kmer <> ''")


def one_row_each(seqs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, seq, joins) with each sequence in one row, and the rows (id, seq) of those too long for that, or None.

    What belongs to one row is worked out where the row is read, and no window
    is shuffled. Rows of one id are joined by line ends, which break windows;
    ``joins`` counts them.
    """
    seqs = seqs.select("id", "seq")
    many = seqs.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("many"))
    whole = seqs.withColumn("joins", F.lit(0).cast("long"))
    if many.isEmpty():
        return whole, None
    own = F.col("id").eqNullSafe(F.col("many"))
    many = small_side(many)
    alone, again = whole.join(many, own, "left_anti"), seqs.join(many, own, "left_semi")
    letters = F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0).cast("long"))
    long = again.groupBy("id").agg(letters.alias("letters")).where(F.col("letters") > JOINED_LETTERS).select(F.col("id").alias("many"))
    parts = None
    if not long.isEmpty():
        long = small_side(long)
        again, parts = again.join(long, own, "left_anti"), again.join(long, own, "left_semi")
    joined = again.groupBy("id").agg(F.array_join(F.collect_list("seq"), "\n").alias("seq"), F.greatest(F.count("seq") - 1, F.lit(0).cast("long")).alias("joins"))
    return alone.unionByName(joined), parts


def own_windows(texts: pa.Array, k: int, canonical: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, n) of each window of every text once, sorted by row and code."""
    codes, row = dna.window_codes(*raw(texts), k, canonical)
    if 2 * k + len(texts).bit_length() <= 63:
        key = row << (2 * k) | codes
        key.sort()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        row, codes = key[first] >> (2 * k), key[first] & ((1 << (2 * k)) - 1)
        return row, codes, np.diff(first, append=len(key))
    order = np.lexsort((codes, row))
    codes, row = codes[order], row[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    return row[first], codes[first], np.diff(first, append=len(codes))


def counted(seqs: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(id, kmer, n): each canonical window that a sequence has at least ``least`` times."""
    _check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in cuts(batch.column("seq")):
                row, codes, n = own_windows(texts, k)
                kept = n >= least
                yield from pieces(pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[kept] + first)), pa.array(codes[kept]), pa.array(n[kept])], names=["id", "kmer", "n"]))

    whole, parts = one_row_each(seqs)
    out = whole.select("id", "seq").mapInArrow(run, StructType([seqs.schema["id"], StructField("kmer", LongType()), StructField("n", LongType())]))
    if parts is None:
        return out
    return out.unionByName(windows(parts, k).groupBy("id", "kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least))


def distinct(seqs: DataFrame, k: int) -> DataFrame:
    """(id, kmer) of each canonical window once."""
    return counted(seqs, k).select("id", "kmer")


def abundant(seqs: DataFrame, k: int, least: int) -> DataFrame:
    """(id, kmer, n) of the canonical windows that a sequence has at least ``least`` times."""
    return counted(seqs, k, least)


def summary(seqs: DataFrame, k: int) -> DataFrame:
    """(id, n_bases, n_kmers, n_distinct, least, most): letters of each sequence, its windows, and its first and last window in order, null if it has none."""
    _check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in cuts(batch.column("seq")):
                row, codes, n = own_windows(texts, k)
                bounds = np.searchsorted(row, np.arange(len(texts) + 1))
                held = np.diff(bounds)
                total = np.diff(np.concatenate([[0], np.cumsum(n)])[bounds])
                none = held == 0
                ends = [np.where(none, 0, codes[np.minimum(at, len(codes) - 1)]) if len(codes) else np.zeros(len(texts), np.int64) for at in (bounds[:-1], bounds[1:] - 1)]
                own = batch.slice(first, len(texts))
                letters = pc.utf8_length(texts).to_numpy().astype(np.int64) - own.column("joins").to_numpy()
                yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(letters), pa.array(total.astype(np.int64)), pa.array(held.astype(np.int64)), *(pa.array(e, mask=none) for e in ends)], names=["id", *SUMMARY])

    whole, parts = one_row_each(seqs)
    out = whole.mapInArrow(run, StructType([seqs.schema["id"], *(StructField(c, LongType()) for c in SUMMARY)]))
    if parts is None:
        return out
    counts = windows(parts, k, with_length=True).groupBy("id", "kmer").agg(F.sum("n").alias("n"))
    some = F.col("kmer").isNotNull()
    sums = [F.sum(F.when(~some, F.col("n"))), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0).cast("long")), F.count("kmer"), F.min("kmer"), F.max("kmer")]
    return out.unionByName(counts.groupBy("id").agg(*[c.alias(name) for c, name in zip(sums, SUMMARY)]))


def with_sizes(whole: DataFrame, k: int) -> DataFrame:
    """``whole`` (of ``one_row_each``) with the number of distinct windows of each row in n_kmers."""
    _check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in cuts(batch.column("seq")):
                row, _, _ = own_windows(texts, k)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, pa.array(np.bincount(row, minlength=len(texts)))], names=[*batch.schema.names, "n_kmers"])

    return whole.mapInArrow(run, StructType([*whole.schema.fields, StructField("n_kmers", LongType())]))


def profile(seqs: DataFrame, k: int) -> DataFrame:
    """(id, n_bases, n_kmers, n_distinct, uniqueness): windows of each sequence; uniqueness is distinct windows a base."""
    sums = summary(seqs, k).select("id", "n_bases", "n_kmers", "n_distinct")
    return sums.withColumn("uniqueness", F.when(F.col("n_bases") > 0, F.col("n_distinct") / F.col("n_bases")).otherwise(F.lit(0.0)))


def within_limit(counted: DataFrame, most: int) -> DataFrame:
    """Of (id, kmer, ...) the sequences of at most ``most`` windows; the others are invalid as a whole."""
    many = counted.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("id")
    return counted.join(many, "id", "left_anti")


def with_windows(reads: DataFrame, k: int) -> DataFrame:
    """``reads`` (with a column seq) with their distinct canonical windows in ``kmers`` and the number of all in ``n_total``."""
    _check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in cuts(batch.column("seq")):
                codes, row = dna.window_codes(*raw(texts), k)
                order = np.lexsort((codes, row))
                codes, row = codes[order], row[order]
                fresh = np.ones(len(codes), bool)
                fresh[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
                offsets = np.searchsorted(row[fresh], np.arange(len(texts) + 1)).astype(np.int32)
                own = batch.slice(first, len(texts))
                total = np.bincount(row, minlength=len(texts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(offsets, pa.array(codes[fresh])), pa.array(total)], names=[*own.schema.names, "kmers", "n_total"])

    return reads.mapInArrow(run, StructType([*reads.schema.fields, StructField("kmers", ArrayType(LongType())), StructField("n_total", IntegerType())]))


def filtered_reads(reads: DataFrame, k: int, min_length: int = 0, min_kmers: int = 1, min_complexity: float = 0.75) -> DataFrame:
    """``reads`` (with a column seq) that are long and varied enough, with their distinct windows in ``kmers`` and ``n_total``.

    Complexity is distinct windows over all windows, in single precision; a read exactly at a limit stays.
    """
    seen = with_windows(reads.where(F.length("seq") >= min_length), k)
    share = F.size("kmers").cast("float") / F.col("n_total").cast("float")
    return seen.where((F.col("n_total") >= max(1, min_kmers)) & (share.cast("float") >= F.lit(min_complexity).cast("float")))
