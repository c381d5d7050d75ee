"""Search by exact k-mer containment: runs that hold enough of a query's windows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strandwise.functions.arrow import cuts
from strandwise.operators import kmers
from strandwise.operators.common import small_side
from strandwise.session import materialize


#: So many windows of queries are held by every task of a search; more are joined.
HELD_WINDOWS = 1 << 21
#: Windows up to this length are looked up in a table of all of them.
TABLE_K = 11


def needed(threshold: float, n: Column) -> Column:
    """Windows that a hit must have: threshold times n in single precision, truncated."""
    return F.floor((F.lit(threshold).cast("float") * n.cast("float")).cast("float")).cast("int")


def query_sets(queries: DataFrame, k: int) -> DataFrame:
    """(query_id, kmer, num_kmers): the distinct canonical windows of the queries (id, seq)."""
    own = kmers.distinct(queries, k).select(F.col("id").alias("query_id"), "kmer")
    totals = own.groupBy("query_id").agg(F.count("*").cast("int").alias("num_kmers"))
    return own.join(totals, "query_id")


def finish(found: DataFrame, totals: DataFrame, runs: DataFrame, threshold: float) -> DataFrame:
    """Applies the threshold to (query_id, run_id, num_kmers, num_kmers_found).

    A query whose truncated threshold is 0 matches every run, also those of
    which it has no window: these pairs are added with a count of 0.
    """
    totals = materialize(totals)
    hits = found.where(F.col("num_kmers_found") >= needed(threshold, F.col("num_kmers")))
    free = totals.where(needed(threshold, F.col("num_kmers")) == 0)
    if free.isEmpty():
        return hits
    hits = materialize(hits)
    # a free query pairs with all runs by what it means, in as many rows as its result has
    all_pairs = free.crossJoin(runs.select("run_id").distinct()).withColumn("num_kmers_found", F.lit(0))
    rest = all_pairs.join(hits.select("query_id", "run_id"), ["query_id", "run_id"], "left_anti")
    return hits.unionByName(rest)


class Held(NamedTuple):
    """The windows of all queries, each once, and for each the queries that have it."""

    ids: pa.Array  # of the queries
    totals: np.ndarray  # windows of each query
    codes: np.ndarray  # sorted
    bounds: np.ndarray  # queries of a window: owners[bounds[i]:bounds[i + 1]]
    owners: np.ndarray

    def places(self, codes: np.ndarray, k: int) -> np.ndarray:
        """The number of each window among ``codes``, -1 for one that no query has."""
        if k <= TABLE_K:
            at = np.full(1 << (2 * k), -1, np.int32)
            at[self.codes] = np.arange(len(self.codes))
            return at[codes]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1)

    def counts(self, window: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, windows of the query) from the numbers of windows that the rows have."""
        n = self.bounds[window + 1] - self.bounds[window]
        first = np.repeat(self.bounds[window] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else n
        key = self.owners[first + np.arange(len(first))] * np.int64(rows) + np.repeat(row, n)
        if len(self.ids) * rows <= 1 << 22:
            count = np.bincount(key, minlength=1)
            key = np.flatnonzero(count)
            return key // rows, key % rows, count[key]
        key, count = np.unique(key, return_counts=True)
        return key // rows, key % rows, count


def held_queries(wanted: DataFrame, most: int) -> Held | None:
    """The windows of ``query_sets`` for every task, or None if they are more than ``most`` or none at all."""
    rows = wanted.select("query_id", "kmer").limit(most + 1).toArrow().combine_chunks()
    if not 0 < rows.num_rows <= most:
        return None
    column = rows.column("query_id").combine_chunks()
    own = column.dictionary_encode(null_encoding="encode")
    query, kmer = own.indices.to_numpy().astype(np.int64), rows.column("kmer").to_numpy()
    order = np.argsort(kmer, kind="stable")
    codes, first = np.unique(kmer[order], return_index=True)
    return Held(own.dictionary, np.bincount(query, minlength=len(own.dictionary)), codes, np.append(first, len(kmer)), query[order])


def shared(runs: DataFrame, wanted: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(query_id, run_id, num_kmers, num_kmers_found) of every run (id, seq) that shares a window with a query of ``query_sets``.

    With ``threshold``, of the runs that hold enough of its windows. The windows
    of a run are looked up and counted where it is read. Runs that are too long
    for one task, and queries of too many windows for it, are joined: there too
    windows meet before anything is shuffled.
    """
    table = held_queries(wanted, HELD_WINDOWS)
    if table is None:
        return _joined(runs, wanted, k, threshold)
    whole, parts = kmers.one_row_each(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = table.places(np.arange(1 << (2 * k)), k) if k <= TABLE_K else None
        for batch in batches:
            for first, texts in cuts(batch.column("seq")):
                row, codes, _ = kmers.own_windows(texts, k)
                at = table.places(codes, k) if lookup is None else lookup[codes]
                query, own, found = table.counts(at[at >= 0].astype(np.int64), row[at >= 0], len(texts))
                total = table.totals[query]
                if threshold is not None:
                    kept = found >= np.floor(np.float32(threshold) * total.astype(np.float32))
                    query, own, found, total = query[kept], own[kept], found[kept], total[kept]
                yield pa.RecordBatch.from_arrays([table.ids.take(pa.array(query)), batch.column("id").take(pa.array(own + first)), pa.array(total, pa.int32()), pa.array(found, pa.int32())], names=["query_id", "run_id", "num_kmers", "num_kmers_found"])

    fields = [wanted.schema["query_id"], StructField("run_id", runs.schema["id"].dataType), StructField("num_kmers", IntegerType()), StructField("num_kmers_found", IntegerType())]
    out = whole.mapInArrow(run, StructType(fields))
    return out if parts is None else out.unionByName(_joined(parts, wanted, k, threshold))


def _joined(runs: DataFrame, wanted: DataFrame, k: int, threshold: float | None) -> DataFrame:
    words = small_side(wanted.select("kmer").distinct())
    common = kmers.windows(runs, k).join(words, "kmer", "left_semi").distinct()
    out = common.join(small_side(wanted), "kmer").groupBy("query_id", F.col("id").alias("run_id"), "num_kmers").agg(F.count("*").cast("int").alias("num_kmers_found"))
    return out if threshold is None else out.where(F.col("num_kmers_found") >= needed(threshold, F.col("num_kmers")))


def exact(runs: DataFrame, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, run_id, num_kmers, num_kmers_found) of the runs (id, seq) that a query (id, seq) matches."""
    wanted = query_sets(queries, k)
    return finish(shared(runs, wanted, k, threshold), wanted.select("query_id", "num_kmers").distinct(), runs.select(F.col("id").alias("run_id")), threshold)


def reads(reads_: DataFrame, subjects: DataFrame, k: int, threshold: float = 0.8, top: int | None = None, **limits) -> DataFrame:
    """(accession, subject_id, read_index, read_subindex, score): reads that hold enough of their windows in a subject.

    The score is the share of a read's distinct windows that the subject has,
    in single precision. With ``top``, the best so many of each accession and
    subject, by score, then read_index and read_subindex.
    """
    key = ["accession", "read_index", "read_subindex"]
    kept = kmers.filtered_reads(reads_, k, **limits).select(*key, F.size("kmers").alias("n"), F.explode("kmers").alias("kmer"))
    wanted = kmers.distinct(subjects, k).select(F.col("id").alias("subject_id"), "kmer")
    hits = kept.join(small_side(wanted), "kmer").groupBy(*key, "subject_id", "n").agg(F.count("*").alias("found"))
    score = (F.col("found").cast("float") / F.col("n").cast("float")).cast("float")
    out = hits.select("accession", "subject_id", "read_index", "read_subindex", score.alias("score")).where(F.col("score") >= F.lit(threshold).cast("float"))
    if top is None:
        return out
    best = Window.partitionBy("accession", "subject_id").orderBy(F.desc("score"), "read_index", "read_subindex")
    return out.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).drop("place")
