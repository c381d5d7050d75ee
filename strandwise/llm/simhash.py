"""Near-duplicate removal by SimHash, with bit-sliced comparison.

A fingerprint has 256 bits, each the majority of that bit over the hashes of
the document's distinct words (runs of ASCII letters and digits and of letters
beyond ASCII, lower-cased; of CJK scripts every character). Documents within RADIUS bits are near
copies, and the connected groups of near copies keep their smallest doc_id.

Candidates share the value of a random sample of bits in one of several
tables; sample width and table count follow the number of fingerprints, so
that a bucket stays small and a pair at RADIUS itself is met in 9 of 10 cases
at every size, a nearer pair more often. Inside a bucket every pair is compared: 64 fingerprints
lie as vertical bit planes, a query is XORed with a plane at a time, the
mismatches are added by carry-save full adders into bit-sliced counters, and
a block is abandoned as soon as all its lanes are beyond the radius. A bucket
gives a star of edges for each of its groups, so its output is linear.

A bucket of more than HOT_POINTS fingerprints is no single task's work: all
its points are compared with its first one where they are, and those beyond
the radius are dealt into blocks, of which each meets each block of the whole
bucket, so that every pair is still compared or joined through the first.

Defined cases: a document without any word (null or empty text, or only
punctuation) is nobody's copy and stays; of an empty table nothing is left.
Rows without a doc_id stay. Rows that repeat a doc_id count as one document and
stand or fall together. Texts of any length count whole; a pair exactly at the
radius is near. Further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import buffers, discard, lower, materialize, mix, slices, small_side, span_hashes, table, without, words_of

WORDS = 4  # 64-bit words of a fingerprint
BITS = 64 * WORDS
RADIUS = 48
DESIGN_DISTANCE = RADIUS
DESIGN_RECALL = 0.9
HOT_POINTS = 50_000
CHECK_EVERY = 32  # planes between two looks at what can be abandoned

_LANES = np.array([[int(b) for b in f"{v:08b}"] for v in range(256)], np.uint8).view(np.uint64).ravel()
_FIELDS = [f"f{k}" for k in range(WORDS)]


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of the texts that have a word: n x WORDS uint64, their positions)."""
    data, offsets = buffers(lower(texts))
    starts, ends, rows = words_of(data, offsets)
    if not len(starts):
        return np.zeros((0, WORDS), np.uint64), np.zeros(0, np.int64)
    hashes = span_hashes(data, starts, ends)
    # a slice has fewer than 2**24 rows; 40 bits of a word's hash stand for it
    keys = np.unique((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    rows = (keys >> np.uint64(40)).astype(np.int64)
    words = keys & np.uint64((1 << 40) - 1)
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    count = np.diff(first, append=len(rows))
    # byte lanes hold at most 255, so a long document is summed in segments
    within = np.arange(len(rows)) - np.repeat(first, count)
    segment = np.flatnonzero(within % 255 == 0)
    segment_first = np.searchsorted(segment, first)
    out = np.empty((len(first), WORDS), np.uint64)
    for k in range(WORDS):
        random = mix(words * np.uint64(2 * k + 0x51ED27) + np.uint64(k + 1))
        lanes = _LANES[random.view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, segment, axis=0).view(np.uint8).reshape(-1, 64)
        ones = np.add.reduceat(sums.astype(np.int64), segment_first, axis=0)
        out[:, k] = np.packbits(2 * ones > count[:, None], axis=1).view(np.uint64).ravel()
    return out, rows[first]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut, texts in slices(batch, "body"):
            prints, at = fingerprints(texts)
            columns = [cut.column("id").take(pa.array(at)), *[pa.array(prints[:, k].view(np.int64)) for k in range(WORDS)]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *_FIELDS])


class _Groups:
    """Union-find over positions; the root of a group is its smallest position."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = self.parent[up]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins each a with its b."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.parent, b, a)


def _planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (a multiple of 64 of them): BITS x blocks, uint64; lane i is bit i."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1).reshape(-1, 64, BITS)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").transpose(2, 0, 1)).view(np.uint64)[:, :, 0]


def close_lanes(planes: np.ndarray, query_bits: np.ndarray, query: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For tasks (query, block): which of the lanes asked for lie within the radius.

    planes: BITS x blocks; query_bits: BITS x queries, 0 or all ones. Returns
    the tasks that have such lanes and their lanes as bits of a uint64.
    """
    task = np.arange(len(query))
    width = BITS.bit_length()
    counters = [np.zeros(len(task), np.uint64) for _ in range(width)]
    beyond_of = radius + 1
    for at in range(0, BITS, CHECK_EVERY):
        pending: list[list[np.ndarray]] = [[] for _ in range(width + 1)]
        for b in range(at, at + CHECK_EVERY):
            pending[0].append(planes[b, block] ^ query_bits[b, query])
            level = 0
            # a full adder takes three values of one weight to one of it and a carry
            while len(pending[level]) >= 2 and level < width:
                x, y = pending[level].pop(), pending[level].pop()
                z = counters[level]
                half = x ^ y
                counters[level] = half ^ z
                pending[level + 1].append((x & y) | (half & z))
                level += 1
        for level in range(width):
            for x in pending[level]:
                carry = counters[level] & x
                counters[level] = counters[level] ^ x
                pending[level + 1].append(carry)
        # counter >= beyond_of, from the highest bit down
        over, same = np.zeros(len(task), np.uint64), np.full(len(task), ~np.uint64(0))
        for level in reversed(range(width)):
            if beyond_of >> level & 1:
                same &= counters[level]
            else:
                over |= same & counters[level]
                same &= ~counters[level]
        lanes = lanes & ~(over | same)
        alive = np.flatnonzero(lanes)
        if len(alive) < len(task):
            task, query, block, lanes = task[alive], query[alive], block[alive], lanes[alive]
            counters = [c[alive] for c in counters]
            if not len(task):
                break
    return task, lanes


def _compare(prints: np.ndarray, query: np.ndarray, lo: np.ndarray, hi: np.ndarray, groups: _Groups, radius: int, chunk: int = 1 << 15) -> None:
    """Joins each query with the positions in its range lo..hi that lie within the radius."""
    if not len(query):
        return
    blocks = -(-len(prints) // 64)
    padded = np.zeros((blocks * 64, WORDS), np.uint64)
    padded[: len(prints)] = prints
    planes = _planes(padded)
    first, last = lo // 64, (hi - 1) // 64
    tasks_of = last - first + 1
    ends = np.cumsum(tasks_of)
    at = 0
    while at < len(query):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
        own = np.arange(at, to)
        asked = np.repeat(own, tasks_of[at:to])
        block = np.arange(len(asked)) - np.repeat(np.cumsum(tasks_of[at:to]) - tasks_of[at:to], tasks_of[at:to]) + first[asked]
        low = np.maximum(lo[asked] - block * 64, 0).astype(np.uint64)
        high = np.minimum(hi[asked] - block * 64, 64).astype(np.uint64)
        ones = ~np.uint64(0)
        lanes = (ones << low) & (ones >> (np.uint64(64) - high))
        bits = np.unpackbits(prints[query[own]].view(np.uint8), axis=1).T
        query_bits = np.where(bits == 1, ones, np.uint64(0))
        task, lanes = close_lanes(planes, query_bits, asked - at, block, lanes, radius)
        if len(task):
            which, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            groups.join(query[asked[task[which]]], block[task[which]] * 64 + lane)
        at = to


def bucket_groups(keys: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by key: the first position of each row's group of near copies within its bucket.

    All pairs of a bucket count. In a bucket of several blocks its first row
    is compared with all, and afterwards only rows outside the largest group
    found so far are queries: the pairs inside that group are joined already.
    """
    groups = _Groups(len(keys))
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ 1 if len(keys) else 0))
    size = np.diff(first, append=len(keys))
    small = size <= 256
    start, count = first[small & (size > 1)], size[small & (size > 1)]
    query = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    end = np.repeat(start + count, count)
    open_ = query + 1 < end
    _compare(prints, query[open_], query[open_] + 1, end[open_], groups, radius)
    for lo, n in zip(first[~small], size[~small]):
        own = prints[lo : lo + n]
        inner = _Groups(n)
        _compare(own, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, n), inner, radius)
        roots = inner.roots(np.arange(n))
        largest = np.bincount(roots).argmax()
        # with the largest group at the end, every query looks at all that follow it
        order = np.concatenate([np.flatnonzero(roots != largest), np.flatnonzero(roots == largest)])
        queries = np.arange(int((roots != largest).sum()))
        moved = _Groups(n)
        _compare(own[order], queries, queries + 1, np.full(len(queries), n), moved, radius)
        inner.join(order, order[moved.roots(np.arange(n))])
        groups.join(np.arange(lo, lo + n), lo + inner.roots(np.arange(n)))
    return groups.roots(np.arange(len(keys)))


def _edge_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: pa.Table) -> pa.RecordBatch:
            keys = rows.column("key").to_numpy()
            ids = rows.column("id").to_numpy()
            prints = np.column_stack([rows.column(f).to_numpy() for f in _FIELDS]).view(np.uint64)
            roots = bucket_groups(keys, np.ascontiguousarray(prints), radius)
            linked = np.flatnonzero(roots != np.arange(len(roots)))
            a, b = ids[linked], ids[roots[linked]]
            pairs = np.unique(np.column_stack([np.maximum(a, b), np.minimum(a, b)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # a bucket may go on in the next batch: only the rows before its last key are complete
            keys = batch.column("key").to_numpy()
            done = int(np.searchsorted(keys, keys[-1]))
            if done:
                rows = pa.Table.from_batches([*held[:-1], batch.slice(0, done)])
                yield edges(rows)
                held = [batch.slice(done)]
        if held:
            yield edges(pa.Table.from_batches(held))

    return run


def tables_for(n: int, design: int = DESIGN_DISTANCE, recall: float = DESIGN_RECALL) -> tuple[int, int]:
    """(bits sampled for a key, number of tables) for n fingerprints; buckets of random ones hold 128 to 256."""
    sample = max(8, math.ceil(math.log2(max(n, 2))) - 8)
    # the bits of a sample differ from each other, so none of the design bits that differ may be drawn
    hit = math.comb(BITS - design, sample) / math.comb(BITS, sample)
    return sample, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _masks(n: int) -> np.ndarray:
    """The sampled bits of each table: tables x BITS, 0 or 1."""
    sample, tables = tables_for(n)
    rng = np.random.default_rng(20240607)
    masks = np.zeros((tables, BITS), np.uint8)
    for mask in masks:
        mask[rng.choice(BITS, sample, replace=False)] = 1
    return masks


def _keys(n: int) -> Column:
    """An array of bucket keys, one a table."""
    keys = []
    for t, mask in enumerate(_masks(n)):
        parts = np.packbits(mask).view(np.int64)
        keys.append(F.xxhash64(F.lit(t), *[F.col(f).bitwiseAND(F.lit(int(m))) for f, m in zip(_FIELDS, parts)]))
    return F.array(*keys)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in ``edges`` (u, v): root is the smallest id of its connected component.

    Alternating large-star and small-star steps, each written to the shared
    folder, until the edges stay the same.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges, old = materialize(small.where("u <> v").distinct()), edges
        discard(old)
        after = state(edges)
        if tuple(after) == tuple(before):
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _dealt(keyed: DataFrame, radius: int, hot_points: int) -> tuple[DataFrame, DataFrame | None]:
    """(``keyed`` with buckets of more than ``hot_points`` cut into blocks, edges of their points to their first one)."""
    hot = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_points))
    if hot.isEmpty():
        return keyed.withColumn("first", F.lit(False)), None
    cold = keyed.join(small_side(hot.select("key")), "key", "left_anti").withColumn("first", F.lit(False))
    members = materialize(keyed.join(small_side(hot), "key"))
    middle = members.groupBy("key").agg(F.min_by(F.struct("id", *_FIELDS), "id").alias("middle"))
    far = sum((F.bit_count(F.col(f).bitwiseXOR(F.col("middle")[f])) for f in _FIELDS), F.lit(0))
    members = materialize(members.join(small_side(middle), "key").withColumn("near", far <= radius))
    star = members.where("near and id <> middle.id").select(F.col("id").alias("u"), F.col("middle.id").alias("v"))
    outside = members.where("not near").groupBy("key").agg(F.ceil(F.count("*") / hot_points).cast("int").alias("rest_blocks"))
    members = members.join(small_side(outside), "key").withColumn("blocks", F.ceil(F.col("n") / hot_points).cast("int"))
    block = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    point = ["key", "id", *_FIELDS]
    all_points = members.select(*point, block(1, "blocks").alias("i"), every("rest_blocks").alias("j"))
    rest = members.where("not near").select(*point, block(2, "rest_blocks").alias("j"), every("blocks").alias("i"))
    # the first point comes first in every block: what is near to it needs no comparison of its own
    leads = members.where("id = middle.id").select(*point, "rest_blocks", every("blocks").alias("i")).select(*point, "i", every("rest_blocks").alias("j"))
    cut = all_points.withColumn("first", F.lit(False)).unionByName(rest.withColumn("first", F.lit(False))).unionByName(leads.withColumn("first", F.lit(True)))
    return cold.unionByName(cut.select(F.xxhash64("key", "i", "j").alias("key"), "id", *_FIELDS, "first")), star


def near_groups(docs: DataFrame, radius: int = RADIUS, hot_points: int = HOT_POINTS) -> DataFrame:
    """(id, root) of every document that has a near copy; root is the one that stays."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body"))
    schema = "id long, " + ", ".join(f"{f} long" for f in _FIELDS)
    prints = materialize(rows.mapInArrow(_fingerprint_batches, schema))
    # equal fingerprints are one point of the search
    points = materialize(prints.groupBy(*_FIELDS).agg(F.min("id").alias("id")))
    same = prints.alias("a").join(points.withColumnRenamed("id", "first"), _FIELDS).where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v"))
    keyed = points.select(F.explode(_keys(points.count())).alias("key"), "id", *_FIELDS)
    dealt, star = _dealt(keyed, radius, hot_points)
    near = dealt.repartition("key").sortWithinPartitions("key", F.desc("first")).drop("first").mapInArrow(_edge_batches(radius), "u long, v long")
    out = materialize(components(same.union(near) if star is None else same.union(near).union(star)))
    discard(prints, points)
    return out


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest doc_id."""
    return without(docs, near_groups(docs, radius).where("id <> root").select(F.col("id").alias("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay."""
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source")
