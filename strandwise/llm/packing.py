"""Best-fit packing with conflicts.

Documents are cut into pieces of at most CAPACITY tokens and the pieces are
packed, longest first, each into the tightest bin that has room and holds
neither its source nor its duplicate cluster. A token is a run of characters
other than white space, and texts of the same tokens, whatever their case, are
one cluster, unless the caller brings columns for either. Groups of near copies
may be given as further clusters, and the query over all documents does so.

Bins are ordered by residual capacity. Each carries a bitmap of those of its
sources that are among the HOT_SOURCES most frequent of the corpus, and a set
of its other sources and its clusters; bins of one residual lie in groups of
one bitmap. A tree over the residuals holds the intersection of the bitmaps
below it, so that the successor search skips ranges in which every bin holds
the source already, and goes on until it meets the tightest compatible bin. A
piece that none can take opens a bin.

Best fit depends on every piece before. The corpus is dealt at random into
shards of about SHARD_PIECES pieces, each packed by one task that reads its
pieces as a sorted stream, so no task's work grows with the corpus. A corpus
beyond one shard goes on with rounds in which the bins that aren't full, of
all shards, are dealt anew into groups of about SHARD_PIECES bins and packed
by the same search, a bin now being one piece with all its sources and
clusters, until a round joins fewer than one in a hundred (after a round over
one group no two bins could be joined). Only ids, lengths, sources and cluster
hashes are shuffled, never texts.

Defined cases: a document without tokens (null, empty or blank text) has no
piece and isn't in the result; an empty table has no bins. A null source or
cluster conflicts with nothing; a null doc_id is packed like others, and rows
are dealt to shards by their place, so any number of equal rows is spread. Pieces of one document never
share a bin, and of equally long pieces the one of the smaller (doc_id, piece)
goes first; of equally tight bins the one opened first is taken. Repeated rows
are documents of one cluster and so go to different bins. Texts of any length
are counted whole, and further columns may have any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import NOT_SPACE, buffers, lower, materialize, mix, powers, slices, small_side, span_hashes, spans, table
from strandwise.llm.simhash import near_groups

CAPACITY = 2048
SHARD_PIECES = 1_000_000
HOT_SOURCES = 512

_SALT = 0x9E3779B97F4A7C15 | 1


class Bins:
    """Open bins by residual capacity, with source bitmaps and sets of clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        #: tree[i]: sources that all bins below node i hold; -1 (all bits) where there is none
        self.tree = [-1] * (2 * self.leaves)
        #: for each residual: bitmap -> heap of the bins that hold these sources, and a heap of (first bin, bitmap);
        #: an entry is out of date if its bin isn't the first of its group
        self.groups: list[dict[int, list[int]]] = [{} for _ in range(self.leaves)]
        self.firsts: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]
        self.count = [0] * self.leaves
        self.held: list[dict[int, int]] = [{} for _ in range(self.leaves)]
        self.clusters: dict[int, set[int]] = {}
        self.opened = 0

    def _refresh(self, r: int) -> None:
        bins, tree = self.count[r], self.tree
        common = -1
        if bins:
            common = 0
            for s, n in self.held[r].items():
                if n == bins:
                    common |= 1 << s
        i = r + self.leaves
        if tree[i] == common:
            return
        tree[i] = common
        i >>= 1
        while i:
            both = tree[2 * i] & tree[2 * i + 1]
            if tree[i] == both:
                return
            tree[i] = both
            i >>= 1

    def _bits(self, bitmap: int) -> Iterator[int]:
        while bitmap:
            low = bitmap & -bitmap
            yield low.bit_length() - 1
            bitmap ^= low

    def _push(self, b: int, r: int, bitmap: int) -> None:
        group = self.groups[r].setdefault(bitmap, [])
        heapq.heappush(group, b)
        if group[0] == b:
            heapq.heappush(self.firsts[r], (b, bitmap))

    def _pop(self, r: int, bitmap: int) -> None:
        """Removes the first bin of a group, which is the first of all."""
        group = self.groups[r][bitmap]
        heapq.heappop(group)
        heapq.heappop(self.firsts[r])
        if group:
            heapq.heappush(self.firsts[r], (group[0], bitmap))
        else:
            del self.groups[r][bitmap]

    def _put(self, b: int, r: int, bitmap: int) -> None:
        self._push(b, r, bitmap)
        self.count[r] += 1
        held = self.held[r]
        for s in self._bits(bitmap):
            held[s] = held.get(s, 0) + 1
        self._refresh(r)

    def _take(self, r: int, in_source: int, keys: frozenset[int]) -> tuple[int, int]:
        """(bin, its bitmap) of the first compatible bin of a residual, which is removed, or (-1, 0)."""
        groups, firsts = self.groups[r], self.firsts[r]
        other, blocked, found = [], [], (-1, 0)
        while firsts:
            b, bitmap = firsts[0]
            group = groups.get(bitmap)
            if not group or group[0] != b:
                heapq.heappop(firsts)
            elif bitmap & in_source:
                other.append(heapq.heappop(firsts))
            else:
                self._pop(r, bitmap)
                if not keys or keys.isdisjoint(self.clusters.get(b, ())):
                    found = b, bitmap
                    break
                blocked.append((b, bitmap))
        for entry in other:
            heapq.heappush(firsts, entry)
        for b, bitmap in blocked:
            self._push(b, r, bitmap)
        if found[0] >= 0:
            self.count[r] -= 1
            held = self.held[r]
            for s in self._bits(found[1]):
                held[s] -= 1
                if not held[s]:
                    del held[s]
            self._refresh(r)
        return found

    def _successor(self, r: int, mask: int) -> int:
        """The least residual >= r with a bin that may lack the sources of ``mask`` (any bin for 0), or -1."""
        tree = self.tree
        open_ = (lambda v: not v & mask) if mask else (lambda v: v != -1)
        i = r + self.leaves
        if not open_(tree[i]):
            while True:
                while i & 1:
                    i >>= 1
                    if i <= 1:
                        return -1
                if i == 0:
                    return -1
                i += 1
                if open_(tree[i]):
                    break
                if i & (i + 1) == 0:
                    return -1
            while i < self.leaves:
                i *= 2
                if not open_(tree[i]):
                    i += 1
        return i - self.leaves

    def place(self, tokens: int, mask: int = 0, keys: frozenset[int] = frozenset()) -> int:
        """The bin that takes a piece with the sources of ``mask`` (bits) and further sources and clusters ``keys``."""
        r = tokens
        while (r := self._successor(r, mask) if r <= self.capacity else -1) >= 0:
            b, bitmap = self._take(r, mask, keys)
            if b >= 0:
                break
            r += 1
        else:
            b, bitmap, r = self.opened, 0, self.capacity
            self.opened += 1
        if r > tokens:
            if keys:
                self.clusters.setdefault(b, set()).update(keys)
            self._put(b, r - tokens, bitmap | mask)
        else:
            self.clusters.pop(b, None)
        return b


def measured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of tokens, hash of the lower-cased tokens in order) of every text."""
    data, offsets = buffers(lower(texts))
    starts, ends, rows = spans(data, offsets, NOT_SPACE)
    count = np.bincount(rows, minlength=len(texts)).astype(np.int64)
    key = np.zeros(len(texts), np.uint64)
    if len(starts):
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        within = np.arange(len(rows)) - np.repeat(first, np.diff(first, append=len(rows)))
        key[rows[first]] = np.add.reduceat(span_hashes(data, starts, ends) * powers(_SALT, int(within.max()) + 1)[within], first)
    return count, mix(key + count.astype(np.uint64))


def _measured_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut, texts in slices(batch, "body"):
            count, key = measured(texts)
            yield pa.RecordBatch.from_arrays([cut.column("doc"), cut.column("source"), pa.array(count), pa.array(key.view(np.int64))], names=["doc", "source", "tokens", "key"])


def pieces_of(docs: DataFrame, capacity: int, tokens: Column | None = None, cluster: Column | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(row, doc, piece, n, source, hot, keys) of every piece, written to the shared folder.

    ``hot`` is the number of a frequent source, else null; ``keys`` has what
    else no bin may hold twice. ``groups`` (id, root) has further clusters.
    """
    doc, source = F.col("doc_id").cast("long").alias("doc"), F.col("source").cast("string").alias("source")
    if (tokens is None) != (cluster is None):
        raise ValueError("tokens and cluster come together")
    if tokens is None:
        rows = docs.select(doc, source, F.col("text").alias("body")).mapInArrow(_measured_batches, "doc long, source string, tokens long, key long")
    else:
        rows = docs.select(doc, source, tokens.cast("long").alias("tokens"), F.when(cluster.isNotNull(), F.xxhash64(cluster)).alias("key"))
    rows = rows.where("tokens > 0").withColumn("pieces", F.ceil(F.col("tokens") / capacity).cast("int"))
    # the place of a row is a column of the table that is written, so it stays the same if a task is run again
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    # only clusters of several pieces can conflict; a document without cluster is one of its own
    alone = F.xxhash64(F.lit("row"), "row")
    several = rows.where("key is not null").groupBy("key").agg(F.sum("pieces").alias("n")).where("n > 1").select("key", F.lit(True).alias("several"))
    hot = rows.where("source is not null").groupBy("source").agg(F.sum("pieces").alias("n")).orderBy(F.desc("n"), "source").limit(HOT_SOURCES).select("source").collect()
    numbers = docs.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(hot)], "source string, hot int")
    of_cluster = F.when(F.col("several"), F.col("key")).when(F.col("key").isNull() & (F.col("pieces") > 1), alone)
    of_source = F.when(F.col("hot").isNull() & F.col("source").isNotNull(), F.xxhash64(F.lit("source"), "source"))
    of_group = F.lit(None).cast("long")
    if groups is not None:
        rows = rows.join(small_side(groups.select(F.col("id").alias("doc"), "root")), "doc", "left")
        of_group = F.when(F.col("root").isNotNull(), F.xxhash64(F.lit("group"), "root"))
    cut = rows.join(several, "key", "left").join(F.broadcast(numbers), "source", "left").withColumn("keys", F.array_compact(F.array(of_cluster, of_group, of_source)))
    cut = cut.select("row", "doc", "tokens", "source", "hot", "keys", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    return materialize(cut.select("row", "doc", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece").cast("long") * capacity).cast("int").alias("n"), "source", "hot", "keys"))


def _placed(capacity: int):
    """Packs the rows (shard, mask as numbers, keys, n, ...) of each shard in their order; adds the number of the bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins = None, Bins(capacity)
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for own, n, hots, keys in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "hots", "keys"))):
                if own != shard:
                    shard, bins = own, Bins(capacity)
                mask = 0
                for h in hots:
                    mask |= 1 << h
                out.append(bins.place(n, mask, frozenset(keys)))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("id"), pa.array(out, pa.int64())], names=["shard", "id", "bin"])

    return run


def _packed(rows: DataFrame, shards: int, capacity: int, order: list) -> DataFrame:
    """(shard, id, bin) of rows (shard, id, n, hots, keys, ...) packed in each shard in the order given."""
    dealt = rows.repartition(shards, "shard") if shards > 1 else rows.coalesce(1)
    kind = dict(rows.dtypes)["id"]
    return dealt.sortWithinPartitions("shard", *order).select("shard", "id", "n", "hots", "keys").mapInArrow(_placed(capacity), f"shard int, id {kind}, bin long")


def best_fit(docs: DataFrame, capacity: int = CAPACITY, tokens: Column | None = None, cluster: Column | None = None, groups: DataFrame | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(bin_id, doc_id, piece, first_token, n_tokens) of every piece of ``docs``."""
    pieces = pieces_of(docs, capacity, tokens, cluster, groups)
    shards = max(1, -(-pieces.count() // shard_pieces))
    at = F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int").alias("shard")
    what = F.struct("doc", "piece", "n", "hot", "keys").alias("id")
    order = [F.col("n").desc(), F.col("doc").asc_nulls_last(), "piece", "source", "keys"]
    rows = pieces.select(at, what, "n", F.array_compact(F.array("hot")).alias("hots"), "keys", "doc", "piece", "source")
    placed = _packed(rows, shards, capacity, order).select("shard", "bin", "id.*")
    if shards > 1:
        placed = _joined(materialize(placed), capacity, shard_pieces)
    bin_id = F.concat_ws("-", "shard", "bin").alias("bin_id")
    return placed.select(bin_id, F.col("doc").alias("doc_id"), "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.col("n").alias("n_tokens"))


def _joined(placed: DataFrame, capacity: int, most: int) -> DataFrame:
    """``placed`` (shard, bin, n, hot, keys, ...) with bins joined that aren't full."""
    name = F.struct("shard", "bin").alias("id")
    bins = placed.groupBy(name).agg(F.sum("n").cast("int").alias("n"), F.collect_set("hot").alias("hots"), F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
    bins = materialize(bins.where(F.col("n") < capacity))
    # where each bin of the beginning is now
    into = bins.select("id", F.col("id").alias("now"))
    count = bins.count()
    for turn in range(1, 64):
        groups = max(1, -(-count // most))
        rows = bins.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(groups)).cast("int"))
        moved = _packed(rows, groups, capacity, [F.col("n").desc(), "id"])
        # a joined bin has the name of its first
        first = moved.groupBy("shard", "bin").agg(F.min("id").alias("now"), F.count("*").alias("n"))
        steps = materialize(moved.join(first.where("n > 1"), ["shard", "bin"]).select("id", "now"))
        left = count - steps.agg(F.count("*") - F.count_distinct("now")).first()[0]
        into = materialize(into.join(steps.select(F.col("id").alias("now"), F.col("now").alias("later")), "now", "left").select("id", F.coalesce("later", "now").alias("now")))
        joined = bins.join(steps, "id", "left").groupBy(F.coalesce("now", "id").alias("id"))
        bins = joined.agg(F.sum("n").cast("int").alias("n"), F.array_distinct(F.flatten(F.collect_list("hots"))).alias("hots"), F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"))
        bins = materialize(bins.where(F.col("n") < capacity))
        if groups == 1 or (count - left) * 100 < count:
            break
        count = bins.count()
    final = into.where("id <> now").select(F.col("id.shard").alias("shard"), F.col("id.bin").alias("bin"), "now")
    out = placed.join(final, ["shard", "bin"], "left")
    return out.select(F.coalesce("now.shard", "shard").alias("shard"), F.coalesce("now.bin", "bin").alias("bin"), "doc", "piece", "n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of all documents; near copies are one cluster, too."""
    docs = table(spark, sf_dir, "documents")
    return best_fit(docs, groups=near_groups(docs))
