"""The Bloom index: a filter for each run, as blocks of bits, and transposed as slices.

Filters are sized by the run's number of distinct windows. A filter is kept as
blocks of BLOCK_BITS bits. A file of the index holds the filters of up to 2048
runs of the same parameters, transposed: one slice a bit of the filter, a
bitmap of the runs that have it. A search reads the slices of the bits that
its windows hash to, and nothing else.

The filter of a short run is many times its text. What is worked out over the
filters of runs (id, seq) without keeping them (``blocks_of``, ``differences``,
``pair_sizes``, ``slices_of``, ``search_runs``) therefore moves the texts, and
fills the filters in the task that uses them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from strandwise.functions import bloom, dna
from strandwise.functions.arrow import cuts, raw
from strandwise.functions.hashing import masked, murmur3_windows, window_hashes, with_hashes
from strandwise.operators import kmers
from strandwise.operators.common import small_side
from strandwise.operators.search import finish, held_queries, needed, query_sets
from strandwise.session import materialize

MIN_COUNT = 5
SEEDS = range(5)
BLOCK_BITS = 1 << 15
BLOCK_BYTES = BLOCK_BITS // 8
#: Filters up to this length (log 2) are filled run by run; the bits of longer ones are shuffled to their blocks.
DENSE_LOG = 20
#: The transposed bits of a file of filters up to this length (log 2) fit into one task (64 MB); files of longer ones are made block by block.
FILE_LOG = 18
#: So many windows of queries are held by every task of a search; with more, the slices are dealt to the windows.
QUERY_WINDOWS = 1 << 20
#: Windows of a query that one task looks at for one file.
SEARCH_WINDOWS = 4096
PARAMS = ["kmer_len", "log_2_filter_len", "num_hash"]
SLICES = "kmer_len int, log_2_filter_len int, num_hash int, file long, bit_pos long, slice binary"


def run_params(counted: DataFrame, k: int, shortest: int = bloom.LOG_LEN[0], longest: int = bloom.LOG_LEN[1], p: float = bloom.FALSE_POSITIVE) -> DataFrame:
    """(run_id, kmer_len, log_2_filter_len, num_hash, n_kmers) of the runs of (id, kmer, n) that have a filter."""
    return sized(counted.groupBy("id").agg(F.count("*").alias("n_kmers")), k, shortest, longest, p)


def params_of(seqs: DataFrame, k: int, shortest: int = bloom.LOG_LEN[0], longest: int = bloom.LOG_LEN[1], p: float = bloom.FALSE_POSITIVE) -> DataFrame:
    """``run_params`` of sequences (id, seq); their windows are counted where they are read."""
    return sized(kmers.summary(seqs, k).select("id", F.col("n_distinct").alias("n_kmers")), k, shortest, longest, p)


def sized(sizes: DataFrame, k: int, shortest: int, longest: int, p: float) -> DataFrame:
    """``run_params`` of (id, n_kmers)."""
    fitted = bloom.bloom_params(sizes, "n_kmers", p, shortest, longest).where("num_hash is not null")
    return fitted.select(F.col("id").alias("run_id"), F.lit(k).alias("kmer_len"), "log_2_filter_len", "num_hash", "n_kmers")


def _bits(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of every bit that the windows of a batch set."""
    length, hashes = batch.column("log_2_filter_len").to_numpy().astype(np.int64), batch.column("num_hash").to_numpy()
    bits = window_hashes(batch.column("kmer").to_numpy(), k, SEEDS) & ((np.int64(1) << length) - 1)[:, None]
    row, seed = np.nonzero(np.arange(len(SEEDS))[None, :] < hashes[:, None])
    return row, bits[row, seed]


def build(counted: DataFrame, params: DataFrame, k: int, dense_log: int = DENSE_LOG) -> DataFrame:
    """(run_id, params, block, bits): the filters as blocks of bits, empty ones left out.

    A block may come in several rows, whose union it is (``merged`` makes one
    of them). A run's windows are never needed in one task: those of a short
    filter are few, and of a long one the bits are dealt to its blocks.
    """
    run_type = counted.schema["id"].dataType
    rows = counted.select(F.col("id").alias("run_id"), "kmer").join(small_side(params.select("run_id", *PARAMS)), "run_id")
    schema = StructType().add("run_id", run_type).add("kmer_len", IntegerType()).add("log_2_filter_len", IntegerType()).add("num_hash", IntegerType()).add("block", LongType())

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, bit = _bits(batch, k)
            # rows come sorted by run; a run has one number of blocks at most
            run = batch.column("run_id").dictionary_encode().indices.to_numpy()
            key, at = np.unique(run[row].astype(np.int64) << 32 | bit // BLOCK_BITS, return_inverse=True)
            first = np.zeros(int(run.max()) + 1, np.int64)
            first[run[::-1]] = np.arange(len(run))[::-1]
            order = np.argsort(at, kind="stable")
            bounds = np.searchsorted(at[order], np.arange(len(key) + 1))
            for lo in range(0, len(key), 1024):
                hi = min(lo + 1024, len(key))
                own = order[bounds[lo] : bounds[hi]]
                filled = np.zeros((hi - lo) * BLOCK_BYTES, np.uint8)
                inner = bit[own] % BLOCK_BITS
                np.bitwise_or.at(filled, (at[own] - lo) * BLOCK_BYTES + inner // 8, (1 << (inner % 8)).astype(np.uint8))
                own_rows = pa.array(first[key[lo:hi] >> 32])
                bits = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.arange(hi - lo + 1, dtype=np.int32) * BLOCK_BYTES), pa.py_buffer(filled)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own_rows) for c in ("run_id", *PARAMS)), pa.array(key[lo:hi] & 0xFFFFFFFF), bits], names=["run_id", *PARAMS, "block", "bits"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bit = _bits(batch, k)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("run_id", *PARAMS)), pa.array(bit // BLOCK_BITS), pa.array(bit % BLOCK_BITS)], names=["run_id", *PARAMS, "block", "bit"])

    short = F.col("log_2_filter_len") <= dense_log
    out = rows.where(short).repartition("run_id").sortWithinPartitions("run_id").mapInArrow(dense, StructType(list(schema.fields)).add("bits", BinaryType()))
    if params.where(~short).isEmpty():
        return out
    bits = rows.where(~short).mapInArrow(dealt, StructType(list(schema.fields)).add("bit", LongType()))
    return out.unionByName(bits.groupBy("run_id", *PARAMS, "block").agg(F.bitmap_construct_agg("bit").alias("bits")))


def merged(blocks: DataFrame) -> DataFrame:
    """Each block in one row."""
    return blocks.groupBy("run_id", *PARAMS, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def fitted(whole: DataFrame, k: int, shortest: int, longest: int, p: float) -> DataFrame:
    """(run_id, params, seq) of the rows of ``kmers.one_row_each`` that have a filter."""
    rows = bloom.bloom_params(kmers.with_sizes(whole, k), "n_kmers", p, shortest, longest)
    return rows.where("num_hash is not null and id is not null").select(F.col("id").alias("run_id"), F.lit(k).alias("kmer_len"), "log_2_filter_len", "num_hash", "seq")


def _texts_bits(texts: pa.Array, length: np.ndarray, n_hash: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The bits that each text sets in its filter, in no order and with repeats."""
    codes, row = dna.window_codes(*raw(texts), k)
    hashes = murmur3_windows(codes, k, SEEDS[: int(n_hash.max(initial=1))])
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    for i, (size, n) in enumerate(zip(length.tolist(), n_hash.tolist())):
        yield hashes[bounds[i] : bounds[i + 1], :n].ravel() & np.uint32((1 << size) - 1)


def _filled_blocks(bits: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, n x BLOCK_BYTES) of the blocks of a filter that aren't empty."""
    if length <= DENSE_LOG:
        flags = np.zeros(max(1 << length, BLOCK_BITS), np.uint8)
        flags[bits] = 1
        flags = flags.reshape(-1, BLOCK_BITS)
        at = np.flatnonzero(flags.any(axis=1))
        yield at, np.packbits(flags[at], axis=1, bitorder="little")
        return
    bits = np.unique(bits)
    block = bits // BLOCK_BITS
    own = np.unique(block)
    for lo in range(0, len(own), 256):
        some = bits[np.searchsorted(block, own[lo]) : np.searchsorted(block, own[min(lo + 256, len(own)) - 1], "right")]
        flags = np.zeros((len(own[lo : lo + 256]), BLOCK_BITS), np.uint8)
        flags[np.searchsorted(own[lo : lo + 256], some // BLOCK_BITS), some % BLOCK_BITS] = 1
        yield own[lo : lo + 256].astype(np.int64), np.packbits(flags, axis=1, bitorder="little")


def _fixed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binary values."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def blocks_of(seqs: DataFrame, k: int, shortest: int = bloom.LOG_LEN[0], longest: int = bloom.LOG_LEN[1], p: float = bloom.FALSE_POSITIVE) -> DataFrame:
    """(run_id, params, block, bits) of runs (id, seq): the filters as blocks of bits, each in one row and made where the run is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in cuts(batch.column("seq")):
                own = batch.slice(first, len(texts))
                length, n_hash = (own.column(c).to_numpy() for c in PARAMS[1:])
                held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

                def done() -> pa.RecordBatch:
                    row, at, filled = map(np.concatenate, zip(*held))
                    held.clear()
                    return pa.RecordBatch.from_arrays([*(own.column(c).take(pa.array(row)) for c in ("run_id", *PARAMS)), pa.array(at), _fixed(filled)], names=["run_id", *PARAMS, "block", "bits"])

                for i, bits in enumerate(_texts_bits(texts, length, n_hash, k)):
                    for at, filled in _filled_blocks(bits, int(length[i])):
                        held.append((np.full(len(at), i), at, filled))
                        if sum(len(x) for x, _, _ in held) >= 512:
                            yield done()
                if held:
                    yield done()

    whole, parts = kmers.one_row_each(seqs)
    rows = fitted(whole, k, shortest, longest, p)
    out = rows.mapInArrow(run, StructType([f for f in rows.schema.fields if f.name != "seq"]).add("block", LongType()).add("bits", BinaryType()))
    return out if parts is None else out.unionByName(_parts_blocks(parts, k, shortest, longest, p))


def _parts_blocks(parts: DataFrame, k: int, shortest: int, longest: int, p: float) -> DataFrame:
    """``blocks_of`` runs that are too long for one task."""
    counted = materialize(kmers.distinct(parts, k))
    return merged(build(counted, materialize(run_params(counted, k, shortest, longest, p)), k))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """The filters of two indexes as one; runs that both have are one run."""
    return merged(left.unionByName(right))


def folded(blocks: DataFrame, log_2_len: int) -> DataFrame:
    """The filters as ones of 2**log_2_len bits (15 at least, and no longer than they are): a shorter filter is a longer one folded."""
    return merged(blocks.select("run_id", "kmer_len", F.lit(log_2_len).alias("log_2_filter_len"), F.lit(0).alias("num_hash"), (F.col("block") % ((1 << log_2_len) // BLOCK_BITS)).alias("block"), "bits"))


def postings(blocks: DataFrame) -> DataFrame:
    """(run_id, params, bit_pos): the set bits of ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                bits = np.frombuffer(b"".join(part.column("bits").to_pylist()), np.uint8).reshape(-1, BLOCK_BYTES)
                row, bit = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
                at = part.column("block").to_numpy()[row] * BLOCK_BITS + bit
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in ("run_id", *PARAMS)), pa.array(at)], names=["run_id", *PARAMS, "bit_pos"])

    schema = StructType([blocks.schema["run_id"], *(blocks.schema[c] for c in PARAMS)]).add("bit_pos", LongType())
    return blocks.select("run_id", *PARAMS, "block", "bits").mapInArrow(run, schema)


def _counted(blocks: DataFrame) -> DataFrame:
    """``blocks`` with n, the number of set bits, and places, the sum of their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(BLOCK_BITS, dtype=np.float64)
        for batch in batches:
            n, places = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            block = batch.column("block").to_numpy()
            for i, bits in enumerate(batch.column("bits").to_pylist()):
                own = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
                n[i] = own.sum()
                places[i] = int(own @ place) + n[i] * block[i] * BLOCK_BITS
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(places)], names=[*batch.schema.names[:-1], "n", "places"])

    others = [c for c in blocks.columns if c != "bits"]
    return blocks.select(*others, "bits").mapInArrow(run, StructType([blocks.schema[c] for c in others]).add("n", LongType()).add("places", LongType()))


def occupancy(blocks: DataFrame) -> DataFrame:
    """(run_id, log_2_filter_len, n_set, share, places): how full every filter is, and the sum of the places of its bits."""
    return occupied(merged(blocks))


def occupied(blocks: DataFrame) -> DataFrame:
    """``occupancy`` of blocks that come in one row each."""
    full = _counted(blocks).groupBy("run_id", "log_2_filter_len").agg(F.sum("n").alias("n_set"), F.sum("places").alias("places"))
    return full.select("run_id", "log_2_filter_len", "n_set", (F.col("n_set") / F.pow(F.lit(2.0), "log_2_filter_len")).alias("share"), "places")


def _of_pairs(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, params, block, bits, side) of the blocks of both runs of pairs (left_id, right_id) that have the same parameters."""
    alike = blocks.select("run_id", *PARAMS).distinct()
    pairs = pairs.join(alike.withColumnRenamed("run_id", "left_id"), "left_id").join(alike.withColumnRenamed("run_id", "right_id"), ["right_id", *PARAMS]).select("left_id", "right_id")
    left = blocks.withColumnRenamed("run_id", "left_id").join(pairs, "left_id").withColumn("side", F.lit(1))
    right = blocks.withColumnRenamed("run_id", "right_id").join(pairs, "right_id").withColumn("side", F.lit(2))
    columns = ["left_id", "right_id", *PARAMS, "block", "bits", "side"]
    return left.select(columns).union(right.select(columns))


def combine_pairs(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, params, block, either, both): union and intersection of the filters of pairs of runs, block by block.

    ``blocks`` as of ``merged``; ``both`` is null where only one side has the
    block. What is in the union and not in the intersection is the difference.
    """
    one = _of_pairs(blocks, pairs).groupBy("left_id", "right_id", *PARAMS, "block")
    both = F.when(F.count("*") == 2, F.bitmap_and_agg("bits")).alias("both")
    return one.agg(F.bitmap_or_agg("bits").alias("either"), both)


def combined_sizes(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, n_union, places_union, n_intersect, places_intersect, n_xor, places_xor) of pairs of runs."""
    rows = combine_pairs(blocks, pairs)
    parts = rows.select("left_id", "right_id", "block", F.lit("union").alias("part"), F.col("either").alias("bits")).union(rows.where("both is not null").select("left_id", "right_id", "block", F.lit("intersect"), "both"))
    part = lambda name, c: F.coalesce(F.sum(F.when(F.col("part") == name, F.col(c))), F.lit(0).cast("long"))
    sizes = _counted(parts).groupBy("left_id", "right_id").agg(*[part(name, c).alias(f"{c}_{name}") for name in ("union", "intersect") for c in ("n", "places")])
    return sizes.withColumn("n_xor", F.col("n_union") - F.col("n_intersect")).withColumn("places_xor", F.col("places_union") - F.col("places_intersect"))


def difference(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id, n_left, n_right, n_both, n_differ) for pairs of runs with filters of the same parameters."""
    own = blocks.groupBy("run_id").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    both = combine_pairs(blocks, pairs).groupBy("left_id", "right_id").agg(F.coalesce(F.sum(F.bitmap_count("both")), F.lit(0).cast("long")).alias("n_both"))
    out = both.join(own.select(F.col("run_id").alias("left_id"), F.col("n").alias("n_left")), "left_id").join(own.select(F.col("run_id").alias("right_id"), F.col("n").alias("n_right")), "right_id")
    return out.select("left_id", "right_id", "n_left", "n_right", "n_both", (F.col("n_left") + F.col("n_right") - 2 * F.col("n_both")).alias("n_differ"))


def _compared(seqs: DataFrame, pairs: DataFrame, k: int, shortest: int, longest: int, p: float, log_2_len: int | None) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(left_id, right_id, n_left, n_right, n_both, places_left, places_right, places_both) of pairs of runs, and (blocks, pairs) of those with a run too long for one task.

    The texts of both runs meet, and their filters are filled there: folded to
    2**log_2_len bits, or as they are, for pairs of the same parameters.
    """
    whole, parts = kmers.one_row_each(seqs)
    rows = fitted(whole, k, shortest, longest, p)
    side = lambda name: rows.select(*[F.col(c).alias(f"{name}_{c.removeprefix('run_')}") for c in ("run_id", "log_2_filter_len", "num_hash", "seq")])
    met = pairs.select("left_id", "right_id").join(side("left"), "left_id").join(side("right"), "right_id")
    if log_2_len is None:
        met = met.where("left_log_2_filter_len = right_log_2_filter_len and left_num_hash = right_num_hash")
    sums = ["n_left", "n_right", "n_both", "places_left", "places_right", "places_both"]

    def sets(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
        for first, texts in cuts(batch.column(f"{name}_seq")):
            length, n_hash = (batch.column(f"{name}_{c}").to_numpy()[first : first + len(texts)] for c in PARAMS[1:])
            for bits in _texts_bits(texts, length, n_hash, k):
                bits = np.sort(bits if log_2_len is None else bits & np.uint32((1 << log_2_len) - 1))
                fresh = np.ones(len(bits), bool)
                fresh[1:] = bits[1:] != bits[:-1]
                yield bits[fresh]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(sums), batch.num_rows), np.int64)
            for i, (a, b) in enumerate(zip(sets(batch, "left"), sets(batch, "right"))):
                both = np.sort(np.concatenate([a, b]))
                both = both[1:][both[1:] == both[:-1]]
                out[:, i] = len(a), len(b), len(both), *(x.sum(dtype=np.int64) for x in (a, b, both))
            yield pa.RecordBatch.from_arrays([batch.column("left_id"), batch.column("right_id"), *map(pa.array, out)], names=["left_id", "right_id", *sums])

    schema = StructType([met.schema["left_id"], met.schema["right_id"]])
    for name in sums:
        schema.add(name, LongType())
    out = met.mapInArrow(run, schema)
    if parts is None:
        return out, None
    long = materialize(parts.select("id").distinct())
    left, right = (small_side(long.select(F.col("id").alias(c))) for c in ("left_id", "right_id"))
    rest = materialize(pairs.select("left_id", "right_id").join(left, "left_id", "left_semi").unionByName(pairs.select("left_id", "right_id").join(right, "right_id", "left_semi")).distinct())
    own = rest.select(F.col("left_id").alias("id")).union(rest.select("right_id")).distinct()
    return out, (materialize(blocks_of(seqs.join(small_side(own), "id", "left_semi"), k, shortest, longest, p)), rest)


def differences(seqs: DataFrame, pairs: DataFrame, k: int, shortest: int = bloom.LOG_LEN[0], longest: int = bloom.LOG_LEN[1], p: float = bloom.FALSE_POSITIVE) -> DataFrame:
    """``difference`` of the filters of pairs of runs (id, seq), from their texts."""
    met, rest = _compared(seqs, pairs, k, shortest, longest, p, None)
    out = met.select("left_id", "right_id", "n_left", "n_right", "n_both", (F.col("n_left") + F.col("n_right") - 2 * F.col("n_both")).alias("n_differ"))
    return out if rest is None else out.unionByName(difference(*rest))


def pair_sizes(seqs: DataFrame, pairs: DataFrame, k: int, log_2_len: int, shortest: int = bloom.LOG_LEN[0], longest: int = bloom.LOG_LEN[1], p: float = bloom.FALSE_POSITIVE) -> DataFrame:
    """``combined_sizes`` of the filters of pairs of runs (id, seq), folded to 2**log_2_len bits, from their texts."""
    met, rest = _compared(seqs, pairs, k, shortest, longest, p, log_2_len)
    both = lambda c, times: F.col(f"{c}_left") + F.col(f"{c}_right") - times * F.col(f"{c}_both")
    ways = {"union": lambda c: both(c, 1), "intersect": lambda c: F.col(f"{c}_both"), "xor": lambda c: both(c, 2)}
    out = met.select("left_id", "right_id", *[way(c).alias(f"{c}_{name}") for name, way in ways.items() for c in ("n", "places")])
    if rest is None:
        return out
    blocks, pairs = rest
    return out.unionByName(combined_sizes(folded(blocks, log_2_len), pairs))


def combine(blocks: DataFrame, left: int, right: int, how: str) -> DataFrame:
    """(bit_pos) of two filters of the same parameters put together by "or", "and", "xor" or "minus"."""
    bits = postings(blocks)
    a = bits.where(F.col("run_id") == left).select(*PARAMS, "bit_pos")
    b = bits.where(F.col("run_id") == right).select(*PARAMS, "bit_pos")
    ways = {"or": lambda: a.union(b).distinct(), "and": lambda: a.intersect(b), "minus": lambda: a.subtract(b), "xor": lambda: a.subtract(b).union(b.subtract(a))}
    return ways[how]()


def checked(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the checksum of their bytes in crc32."""
    return blocks.withColumn("crc32", F.crc32("bits"))


def damaged(blocks: DataFrame) -> DataFrame:
    """Blocks whose bytes don't have the checksum that is stored with them."""
    return blocks.where(F.crc32("bits") != F.col("crc32"))


def slices(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """(params, file, bit_pos, slice): the transposed layout, for each bit the bitmap of the runs of a file that have it.

    ``ranks`` (run_id, file, place) comes from packing: a file has at most 2048
    places. A task holds one block of one file, so 8 MB of bits.
    """
    rows = blocks.join(small_side(ranks.select("run_id", "file", "place")), "run_id").select(*PARAMS, "file", "block", "place", "bits")

    def transposed(key: tuple, table: pa.Table) -> pa.Table:
        k, length, n_hash, file, block = (x.as_py() for x in key)
        width = min(bloom.FILTERS_PER_FILE, bloom.FILE_BITS >> length)
        filled = np.zeros((width, BLOCK_BYTES), np.uint8)
        for place, bits in zip(table.column("place").to_pylist(), table.column("bits").to_pylist()):
            filled[place] |= np.frombuffer(bits, np.uint8)
        flags = np.unpackbits(filled, axis=1, bitorder="little")
        out = np.packbits(flags.T, axis=1, bitorder="little")
        at = np.flatnonzero(out.any(axis=1))
        value = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * (width // 8)), pa.py_buffer(np.ascontiguousarray(out[at]))])
        same = lambda v, t: pa.array(np.full(len(at), v), t)
        return pa.table([same(k, pa.int32()), same(length, pa.int32()), same(n_hash, pa.int32()), same(file, pa.int64()), pa.array(at + block * BLOCK_BITS), value], names=[*PARAMS, "file", "bit_pos", "slice"])

    return rows.groupBy(*PARAMS, "file", "block").applyInArrow(transposed, SLICES)


def _files(seqs: DataFrame, ranks: DataFrame, k: int, use: Callable[[tuple[int, int, int, int], np.ndarray], Iterator[pa.RecordBatch]], schema: StructType | str) -> tuple[DataFrame, DataFrame | None]:
    """What ``use`` yields for (params, file) and the transposed bits (n x bytes of a slice) of every file of short filters, and the slices of the files of longer ones, or None.

    The texts of a file's runs go to one task, one after the other.
    """
    whole, parts = kmers.one_row_each(seqs)
    at = ranks.select(F.col("run_id").alias("id"), *PARAMS, "file", "place")
    short = F.col("log_2_filter_len") <= FILE_LOG
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = whole.join(small_side(at.where(short)), "id").select(*PARAMS, "file", "place", "seq", none("block", "long"), none("bits", "binary"))
    if parts is not None:
        counted = materialize(kmers.distinct(parts, k))
        blocks = merged(build(counted, materialize(ranks.select("run_id", *PARAMS).join(small_side(parts.select(F.col("id").alias("run_id")).distinct()), "run_id", "left_semi")), k))
        blocks = blocks.where(short).select(F.col("run_id").alias("id"), "block", "bits")
        rows = rows.unionByName(blocks.join(small_side(at.where(short)), "id").select(*PARAMS, "file", "place", none("seq", "string"), "block", "bits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, filled = None, np.zeros((0, 0), np.uint8)
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*PARAMS, "file")], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if batch.num_rows else []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                if key != tuple(keys[lo].tolist()):
                    if key is not None:
                        yield from use(key, filled)
                    key = tuple(keys[lo].tolist())
                    shape = (1 << key[1], min(bloom.FILTERS_PER_FILE, bloom.FILE_BITS >> key[1]) // 8)
                    if filled.shape == shape:
                        filled[:] = 0
                    else:
                        filled = np.zeros(shape, np.uint8)
                part, flat = batch.slice(lo, hi - lo), filled.reshape(-1)
                place = part.column("place").to_numpy()

                def add(i: int, bits: np.ndarray) -> None:
                    flat[bits.astype(np.int64) * filled.shape[1] + (int(place[i]) >> 3)] |= np.uint8(1 << (int(place[i]) & 7))

                for first, texts in cuts(part.column("seq")):
                    for i, bits in enumerate(_texts_bits(texts, np.full(len(texts), key[1]), np.full(len(texts), key[2]), k)):
                        add(first + i, bits)
                for i in np.flatnonzero(part.column("bits").is_valid().to_numpy(zero_copy_only=False)):
                    own = np.frombuffer(part.column("bits")[int(i)].as_py(), np.uint8)
                    add(i, np.flatnonzero(np.unpackbits(own, bitorder="little")) + part.column("block")[int(i)].as_py() * BLOCK_BITS)
        if key is not None:
            yield from use(key, filled)

    out = rows.repartition(*PARAMS, "file").sortWithinPartitions(*PARAMS, "file").mapInArrow(run, schema)
    long = ranks.where(~short)
    if long.isEmpty():
        return out, None
    own = seqs.join(small_side(long.select(F.col("run_id").alias("id"))), "id", "left_semi")
    return out, slices(merged(build(materialize(kmers.distinct(own, k)), long, k)), long)


def slices_of(seqs: DataFrame, ranks: DataFrame, k: int, below: int | None = None) -> DataFrame:
    """``slices`` of runs (id, seq), of the bits below a limit if there is one."""

    def use(key: tuple[int, int, int, int], filled: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(filled[:below].any(axis=1))
        for some in (at[lo : lo + 8192] for lo in range(0, len(at), 8192)):
            same = [pa.array(np.full(len(some), v), t) for v, t in zip(key, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(some), _fixed(filled[some])], names=[*PARAMS, "file", "bit_pos", "slice"])

    out, long = _files(seqs, ranks, k, use, SLICES)
    if long is not None:
        out = out.unionByName(long)
    return out if below is None else out.where(F.col("bit_pos") < below)


def write_slices(slices_: DataFrame, path: str) -> None:
    """Writes the slices of an index: a folder for each set of parameters, sorted by bit, so that a search reads the row groups it needs; each with its checksum."""
    rows = slices_.withColumn("crc32", F.crc32("slice"))
    rows.repartitionByRange(*PARAMS, "bit_pos").sortWithinPartitions(*PARAMS, "bit_pos").write.partitionBy(*PARAMS).mode("overwrite").parquet(path)


def append_slices(slices_: DataFrame, path: str) -> None:
    """Adds files to an index on disk; their numbers must be new."""
    rows = slices_.withColumn("crc32", F.crc32("slice"))
    rows.repartitionByRange(*PARAMS, "bit_pos").sortWithinPartitions(*PARAMS, "bit_pos").write.partitionBy(*PARAMS).mode("append").parquet(path)


def read_slices(spark: SparkSession, *paths: str) -> DataFrame:
    """The slices of the indexes at the paths, each searched deeply; the numbers of their files must differ."""
    parts = [spark.read.schema(SLICES + ", crc32 long").parquet(path) for path in paths]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def damaged_slices(stored: DataFrame) -> DataFrame:
    """Slices whose bytes don't have the checksum that was written with them."""
    return stored.where(F.crc32("slice") != F.col("crc32"))


def dump_slices(slices_: DataFrame, first: int) -> DataFrame:
    """(params, file, bit_pos, bits): the slices of the first bits, spelt out as 0 and 1, place by place."""
    eight = F.transform(F.sequence(F.lit(1), F.length("slice")), lambda i: F.reverse(F.lpad(F.conv(F.hex(F.substring(F.col("slice"), i, F.lit(1))), 16, 2), 8, "0")))
    return slices_.where(F.col("bit_pos") < first).select(*PARAMS, "file", "bit_pos", F.array_join(eight, "").alias("bits"))


def query_bits(queries: DataFrame, params: DataFrame, k: int) -> DataFrame:
    """(query_id, kmer, num_kmers, log_2_filter_len, num_hash, seed, bit_pos) for every filter length and number of hashes in use."""
    own = kmers.distinct(queries, k).select(F.col("id").alias("query_id"), "kmer")
    totals = own.groupBy("query_id").agg(F.count("*").cast("int").alias("num_kmers"))
    kinds = params.select("log_2_filter_len", "num_hash").distinct()
    # at most one row a length and number of hashes: 15 times 5
    rows = with_hashes(own, "kmer", k, SEEDS).join(totals, "query_id").crossJoin(F.broadcast(kinds))
    seeds = rows.select("query_id", "kmer", "num_kmers", "log_2_filter_len", "num_hash", F.posexplode("hashes").alias("seed", "hash")).where("seed < num_hash")
    return seeds.select("query_id", "kmer", "num_kmers", "log_2_filter_len", "num_hash", "seed", masked(F.col("hash"), F.col("log_2_filter_len")).alias("bit_pos"))


def search(slices_: DataFrame, ranks: DataFrame, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, run_id, num_kmers, num_kmers_found) by the slices of an index.

    ``ranks`` (run_id, params, file, place) has the runs; they are looked up
    last, for hits only. A filter holds a window if the bits of all of its
    seeds are set: the slices of these bits are put together by "and", a file
    at a time, and the windows that each place has are counted. Two seeds may
    share a bit. A long query is cut into parts of about SEARCH_WINDOWS
    windows, whose counts are added up.
    """
    hits, totals = _hits(slices_, ranks, queries, k, threshold)
    return finish(hits, totals, ranks.select("run_id"), threshold)


def _hits(slices_: DataFrame, ranks: DataFrame, queries: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The hits of ``search`` and (query_id, num_kmers)."""
    wanted = materialize(query_bits(queries, ranks, k))
    parts = F.ceil(F.col("num_kmers") / SEARCH_WINDOWS).cast("int")
    met = slices_.select(*PARAMS, "file", "bit_pos", "slice").join(small_side(wanted), ["log_2_filter_len", "num_hash", "bit_pos"])
    met = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("kmer"), F.col("parts")).cast("int"))
    query_type = queries.schema["id"].dataType
    schema = StructType().add("query_id", query_type).add("kmer_len", IntegerType()).add("log_2_filter_len", IntegerType()).add("num_hash", IntegerType()).add("file", LongType()).add("num_kmers", IntegerType()).add("place", IntegerType()).add("found", IntegerType())

    def counted(key: tuple, table: pa.Table) -> pa.Table:
        kmer = table.column("kmer").to_numpy()
        order = np.argsort(kmer, kind="stable")
        first = np.flatnonzero(np.diff(kmer[order], prepend=kmer[order[0]] ^ 1))
        n_hash = key[3].as_py()
        full = np.diff(first, append=len(kmer)) == n_hash  # a bit that no run has has no slice
        bits = np.frombuffer(b"".join(table.column("slice").to_pylist()), np.uint8).reshape(len(kmer), -1)[order]
        held = np.bitwise_and.reduceat(bits, first, axis=0)[full]
        count = np.zeros(bits.shape[1] * 8, np.int64)
        for at in range(0, len(held), 1024):
            count += np.unpackbits(held[at : at + 1024], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total = table.column("num_kmers")[0].as_py()
        # if the query is whole here, what misses the threshold goes at once
        least = max(1, int(np.float32(threshold) * np.float32(total))) if table.column("parts")[0].as_py() == 1 else 1
        place = np.flatnonzero(count >= least)
        same = lambda v, t: pa.array([v.as_py() if isinstance(v, pa.Scalar) else v] * len(place), t)
        types = pa.schema([("query_id", key[0].type)])
        return pa.table([same(key[0], types.field(0).type), *(same(x, pa.int32()) for x in key[1:4]), same(key[4], pa.int64()), same(total, pa.int32()), pa.array(place.astype(np.int32)), pa.array(count[place].astype(np.int32))], names=[f.name for f in schema])

    found = met.groupBy("query_id", *PARAMS, "file", "part").applyInArrow(counted, schema)
    found = found.groupBy("query_id", *PARAMS, "file", "num_kmers", "place").agg(F.sum("found").cast("int").alias("num_kmers_found"))
    totals = wanted.select("query_id", "num_kmers").distinct()
    return _placed(found, ranks, threshold), totals


def _placed(found: DataFrame, ranks: DataFrame, threshold: float) -> DataFrame:
    """The runs of (query_id, params, file, place, num_kmers, num_kmers_found) that hold enough."""
    hits = found.where(F.col("num_kmers_found") >= needed(threshold, F.col("num_kmers"))).join(small_side(ranks.select("run_id", *PARAMS, "file", "place")), [*PARAMS, "file", "place"])
    return hits.select("query_id", "run_id", "num_kmers", "num_kmers_found")


def search_runs(seqs: DataFrame, ranks: DataFrame, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """``search`` in the filters of runs (id, seq) whose index isn't stored: each file is searched in the task that fills it."""
    own = query_sets(queries, k)
    table = held_queries(own, QUERY_WINDOWS)
    if table is None:
        return search(slices_of(seqs, ranks, k), ranks, queries, k, threshold)
    names = ["query_id", *PARAMS, "file", "num_kmers", "place", "num_kmers_found"]
    hashes = window_hashes(table.codes, k, SEEDS)

    def use(key: tuple[int, int, int, int], filled: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits, width = hashes[:, : key[2]] & ((1 << key[1]) - 1), filled.shape[1] * 8
        window, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(bits), 4096):
            held = filled[bits[lo : lo + 4096, 0]]
            for seed in range(1, key[2]):
                held &= filled[bits[lo : lo + 4096, seed]]
            row, byte = np.nonzero(held)
            at, inner = np.nonzero(np.unpackbits(held[row, byte][:, None], axis=1, bitorder="little"))
            window.append(row[at] + lo)
            place.append(byte[at] * 8 + inner)
        query, at, found = table.counts(np.concatenate(window), np.concatenate(place), width)
        total = table.totals[query]
        kept = found >= np.maximum(1, np.floor(np.float32(threshold) * total.astype(np.float32)).astype(np.int64))
        query, at, found, total = query[kept], at[kept], found[kept], total[kept]
        same = [pa.array(np.full(len(at), v), t) for v, t in zip(key, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([table.ids.take(pa.array(query)), *same, pa.array(total, pa.int32()), pa.array(at, pa.int32()), pa.array(found, pa.int32())], names=names)

    schema = StructType().add("query_id", queries.schema["id"].dataType).add("kmer_len", IntegerType()).add("log_2_filter_len", IntegerType()).add("num_hash", IntegerType()).add("file", LongType()).add("num_kmers", IntegerType()).add("place", IntegerType()).add("num_kmers_found", IntegerType())
    found, long = _files(seqs, ranks, k, use, schema)
    hits = _placed(found, ranks, threshold)
    if long is not None:
        hits = hits.unionByName(_hits(materialize(long), ranks, queries, k, threshold)[0])
    return finish(hits, own.select("query_id", "num_kmers").distinct(), ranks.select("run_id"), threshold)
