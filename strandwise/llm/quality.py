"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad from its own features and those of the lines
before and after it: shares of capitals, digits, symbols, bars and exclamation
marks, word lengths, repeated neighbouring words, word triples met earlier in
the document, and line length. Forward-backward gives the probability that a
line is good; the quality of a document is their mean, weighted by length.

The field is fitted on at most TRAIN_DOCS labelled documents (those with the
smallest hash of doc_id) of at most TRAIN_CHARS characters, every line taking
the label of its document, and on as many documents put together from stretches
of lines of good and bad ones, each line with the label of its origin. Rows of
``documents`` are scored where they are: nothing is shuffled.

Defined cases: a document without characters (null or empty text, or only line
breaks) has quality 0 and is rejected. A quality at the limit is good, and a
line of equal chances too. Of a doc_id that is labelled both ways the smaller
label counts, and of several texts of a labelled doc_id the smallest. Without
labelled documents of both kinds nothing can be called bad, and every other
document has quality 1. Texts of any length are read whole; an empty table
gives an empty one. Ids may be null or repeated and further columns have any
name; rows are judged one by one.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import NOT_SPACE, buffers, slices, small_side, span_hashes, spans, table
from strandwise.llm.crf import fit, forward_backward
from strandwise.llm.decontaminate import windows

TRAIN_DOCS = 1500
#: Longer labelled texts aren't in the sample.
TRAIN_CHARS = 50_000
GOOD_FROM = 0.5

_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+/<=>@[]\\^_`{}~", b"|", b"!"]
_OF_KIND = np.zeros((len(_KINDS), 256), bool)
for _k, _bytes in enumerate(_KINDS):
    _OF_KIND[_k, list(_bytes)] = True
N_FEATURES = len(_KINDS) + 8


def _sums(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=total[1:])
    return (total[ends] - total[starts]).astype(np.float64)


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line with those of its neighbours, line lengths in bytes, offsets of the documents)."""
    data, offsets = buffers(texts)
    breaks = np.flatnonzero(data == 10)
    of_doc = np.searchsorted(offsets, breaks, "right") - 1
    per_doc = np.bincount(of_doc, minlength=len(texts)) + 1
    line_offsets = np.concatenate([[0], np.cumsum(per_doc)])
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    size = (ends - starts).astype(np.float64)
    some = np.maximum(size, 1)
    columns = [_sums(_OF_KIND[k][data], starts, ends) / some for k in range(len(_KINDS))]
    word_starts, word_ends, doc = spans(data, offsets, NOT_SPACE)
    first, last = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    words = (last - first).astype(np.float64)
    some_words = np.maximum(words, 1)
    if len(word_starts):
        hashes = span_hashes(data, word_starts, word_ends)
        line = np.repeat(np.arange(len(starts)), last - first)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        value, at = windows(hashes, doc, 3)
        key = (doc[at].astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24))
        _, earliest = np.unique(key, return_index=True)
        met = np.zeros(len(hashes), bool)
        met[at] = True
        met[at[earliest]] = False
        long = word_ends - word_starts
        columns += [_sums(again, first, last) / some_words, _sums(met, first, last) / some_words, _sums(long, first, last) / some_words / 10]
    else:
        columns += [np.zeros(len(starts))] * 3
    columns += [np.log1p(size) / 5, words <= 2, columns[2] > 0.05, columns[0] > 0.5, columns[3] > 0]
    own = np.column_stack(columns).astype(np.float64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[line_offsets[:-1]] = 0
    after[line_offsets[1:] - 1] = 0
    return np.column_stack([own, before, after, np.ones(len(own))]), size, line_offsets


@dataclass
class Field:
    weights: np.ndarray
    transitions: np.ndarray

    def lines(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability that each line is good, line lengths, offsets of the documents)."""
        features, size, offsets = line_features(texts)
        marginals, _, _ = forward_backward(features @ self.weights, self.transitions, offsets)
        return marginals[:, 1], size, offsets

    def quality(self, texts: pa.Array) -> np.ndarray:
        return weighted(*self.lines(texts)) if len(texts) else np.zeros(0)


def weighted(good: np.ndarray, size: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean of the lines of each document, weighted by length; 0 for one without characters."""
    total = np.add.reduceat(size, offsets[:-1])
    return np.where(total > 0, np.add.reduceat(good * size, offsets[:-1]) / np.maximum(total, 1), 0.0)


def _spliced(texts: list[str], good: list[int], seed: int = 7) -> tuple[list[str], list[np.ndarray]]:
    """Documents put together from stretches of lines of good and of bad ones, with the label of every line.

    Whole documents alone would teach the field that labels never change.
    """
    rng = random.Random(seed)
    lines = [[t.split("\n") for t, g in zip(texts, good) if g == kind] for kind in (0, 1)]
    out, states = [], []
    for _ in range(len(texts)):
        kind = rng.randint(0, 1)
        text: list[str] = []
        state: list[int] = []
        for _ in range(rng.choice([2, 2, 3])):
            own = rng.choice(lines[kind])
            at = rng.randrange(len(own))
            part = own[at : at + rng.randint(1, 12)]
            text += part
            state += [kind] * len(part)
            kind = 1 - kind
        out.append("\n".join(text))
        states.append(np.array(state))
    return out, states


def train(texts: list[str], good: list[int]) -> Field:
    """The field fitted on labelled documents and on stretches of them put together."""
    more, states = _spliced(texts, good)
    rows = pa.record_batch([pa.array([*texts, *more], pa.large_string())], names=["body"])
    # some texts at a time, to bound the memory
    parts = [line_features(cut) for _, cut in slices(rows, "body", 1 << 19)]
    features = np.concatenate([f for f, _, _ in parts])
    counts = np.concatenate([np.diff(o) for _, _, o in parts])
    offsets, whole = np.concatenate([[0], np.cumsum(counts)]), counts[: len(texts)]
    truth = np.concatenate([np.repeat(np.array(good), whole), *states])
    weights, transitions = fit(lambda w: features @ w, lambda g: features.T @ g, (features.shape[1], 2), truth, offsets)
    return Field(weights, transitions)


def fitted(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Field | None:
    """The field for these tables; None if the labels don't hold both kinds."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.where((F.col("text") != "") & (F.length("text") <= train_chars)).select("doc_id", F.col("text").alias("body")).join(small_side(chosen), "doc_id")
    # one text for each labelled id, so that the sample is bounded in rows and in characters
    rows = sorted(tuple(r) for r in rows.groupBy("doc_id", "quality").agg(F.min("body").alias("body")).select("doc_id", "body", "quality").collect())
    if len({r[2] for r in rows}) < 2:
        return None
    return train([r[1] for r in rows], [r[2] for r in rows])


def _judged(field: Field | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quality of each document, probability that each line is good, offsets of the documents)."""
    if field is not None:
        good, size, offsets = field.lines(texts)
    else:
        _, size, offsets = line_features(texts)
        good = np.ones(len(size))
    return weighted(good, size, offsets), good, offsets


def scores(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, good_from: float = GOOD_FROM) -> DataFrame:
    """(doc_id, quality, good, lines) of every row of ``docs``; ``lines`` says of each line whether it is good."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, texts in slices(batch, "body"):
                quality, good, offsets = _judged(shared.value, texts)
                lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(good >= 0.5))
                yield pa.RecordBatch.from_arrays([cut.column("id"), pa.array(quality), pa.array(quality >= good_from), lines], names=["doc_id", "quality", "good", "lines"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body")).mapInArrow(run, "doc_id long, quality double, good boolean, lines array<boolean>")


def keep_good(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, good_from: float = GOOD_FROM) -> DataFrame:
    """``docs`` without the rows of a quality below ``good_from``."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, texts in slices(batch, "text"):
                yield cut.filter(pa.array(_judged(shared.value, texts)[0] >= good_from))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents."""
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
