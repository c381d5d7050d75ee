"""Benchmark decontamination by greedy string tiling.

Document and item are sequences of words (runs of ASCII letters and digits and
of characters beyond ASCII but for blanks and punctuation, lower-cased; of CJK
scripts every character is a word), so typographic quotes, dashes and blanks
count for no more than plain ones. Seeds are windows of MIN_MATCH words
with a rolling Karp-Rabin hash; a document is joined with the items that share
seeds with it. For each pair, seeds on one diagonal run together into maximal
matches, and the longest match whose words are still free on both sides is
marked again and again, an occluded match leaving its free parts, until none
of MIN_MATCH words is left. The share of the item's words in such tiles is its
coverage: order doesn't matter, so passages put in another order are caught.

A pair whose matched windows can't reach the threshold even if all counted in
full is dropped before tiling; that changes no result. The seed index of the
items is sent to the executors in parts of at most INDEX_BYTES of text, with a
pass over the documents for each part, so its size never depends on the
benchmark's.

Defined cases: null and empty texts, and items of fewer than MIN_MATCH words,
match nothing, nor does anything in an empty table. Texts of any length are
read whole. Of equally long matches the one that comes first in the item goes
first. Further columns may have any name. Repeated items and documents are judged one by one and reported
once. A null doc_id or item_id is reported as null. The filter judges every
row by its own text, whatever its id, and keeps all columns.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import buffers, lower, mix, slices, span_hashes, table, words_of

MIN_MATCH = 3
THRESHOLD = 0.5
INDEX_BYTES = 32 << 20

_SALT = 0xD6E8FEB86659FD93
_FILTER_BITS = 20


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, row of each word)."""
    data, offsets = buffers(lower(texts))
    starts, ends, rows = words_of(data, offsets)
    return span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64), rows


def windows(hashes: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the words from each position on, the positions) for windows inside a row."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for k in range(length):
        value = value * np.uint64(_SALT) + hashes[k : k + n]
    at = np.flatnonzero(rows[:n] == rows[length - 1 :])
    return mix(value[at]), at


class Index:
    """Seeds of a part of the benchmark."""

    def __init__(self, ids: list, texts: list[str], length: int):
        self.length = length
        self.ids = ids
        hashes, rows = words(pa.array(texts, pa.large_string()))
        first = np.searchsorted(rows, np.arange(len(texts) + 1))
        self.size = np.diff(first)
        value, at = windows(hashes, rows, length)
        order = np.argsort(value, kind="stable")
        self.value, self.item, self.at = value[order], rows[at[order]], at[order] - first[rows[at[order]]]
        self.seeds, self.first = np.unique(self.value, return_index=True)
        self.many = np.diff(self.first, append=len(self.value))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word position, item, position in the item) of every shared seed."""
        value, at = windows(hashes, rows, self.length)
        maybe = np.flatnonzero(self.filter[(value >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        value, at = value[maybe], at[maybe]
        seed = np.searchsorted(self.seeds, value)
        found = np.flatnonzero(self.seeds[np.minimum(seed, len(self.seeds) - 1)] == value) if len(self.seeds) else np.zeros(0, np.int64)
        seed, at = seed[found], at[found]
        many = self.many[seed]
        entry = np.repeat(self.first[seed] - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(at, many), self.item[entry], self.at[entry]


def tiled(pattern_at: np.ndarray, text_at: np.ndarray, length: int) -> int:
    """Words of the pattern that greedy string tiling marks, given all pairs of equal windows."""
    order = np.lexsort((pattern_at, text_at - pattern_at))
    p, t = pattern_at[order], text_at[order]
    breaks = np.flatnonzero((np.diff(p) != 1) | (np.diff(t) != 1)) + 1
    heap = []
    for lo, hi in zip([0, *breaks], [*breaks, len(p)]):
        heap.append((-(hi - lo + length - 1), int(p[lo]), int(t[lo])))
    heapq.heapify(heap)
    in_pattern: set[int] = set()
    in_text: set[int] = set()
    while heap:
        size, a, b = heapq.heappop(heap)
        free = [k for k in range(-size) if a + k not in in_pattern and b + k not in in_text]
        if len(free) == -size:
            in_pattern.update(range(a, a - size))
            in_text.update(range(b, b - size))
            continue
        lo = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - lo >= length:
                    heapq.heappush(heap, (lo - k, a + free[lo], b + free[lo]))
                lo = k
    return len(in_pattern)


def coverages(index: Index, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, float]]:
    """(row, item, coverage) of the pairs that reach the threshold."""
    hashes, rows = words(texts)
    at, item, item_at = index.hits(hashes, rows)
    if not len(at):
        return
    pair = rows[at] * len(index.ids) + item
    # item positions with a match, each once, bound what tiles can cover
    width = int(index.size.max()) + 1
    places = np.unique(pair * width + item_at)
    candidate, count = np.unique(places // width, return_counts=True)
    candidate = candidate[count * index.length >= threshold * index.size[candidate % len(index.ids)]]
    keep = np.isin(pair, candidate)
    at, item_at, pair = at[keep], item_at[keep], pair[keep]
    order = np.argsort(pair, kind="stable")
    at, item_at, pair = at[order], item_at[order], pair[order]
    cuts = np.flatnonzero(np.diff(pair, prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(pair)]):
        row, i = divmod(int(pair[lo]), len(index.ids))
        share = tiled(item_at[lo:hi], at[lo:hi], index.length) / int(index.size[i])
        if share >= threshold:
            yield row, i, share


def _parts(items: DataFrame, limit: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for r in items.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1].encode())
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage) of every document and benchmark item that it contains."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("id"), F.col("text").alias("body"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body"))
    schema = "doc_id long, item_id long, coverage double"
    out = spark.createDataFrame([], schema)
    for ids, texts in _parts(items, index_bytes):
        shared = spark.sparkContext.broadcast(Index(ids, texts, min_match))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for cut, part in slices(batch, "body"):
                    found = list(coverages(index, part, threshold))
                    if found:
                        of, item, share = zip(*found)
                        doc = cut.column("id").take(pa.array(of))
                        yield pa.RecordBatch.from_arrays([doc, pa.array([index.ids[i] for i in item], pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "item_id", "coverage"])

        out = out.union(rows.mapInArrow(scan, schema))
    return out.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` without those that contain a benchmark item; each row is judged where it is, so nothing is shuffled."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    for ids, texts in _parts(items, index_bytes):
        shared = spark.sparkContext.broadcast(Index(ids, texts, min_match))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cut, part in slices(batch, "text"):
                    stays = np.ones(cut.num_rows, bool)
                    stays[[row for row, _, _ in coverages(shared.value, part, threshold)]] = False
                    yield cut.filter(pa.array(stays))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the items that they contain."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
