import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.functions import dna
from strandwise.operators import index, inventory, kmers, packing, search

SEQ = "id long, seq string"


def revcomp(w):
    return w[::-1].translate(str.maketrans("ACGT", "TGCA"))


def sets(seq, k):
    return {min(w, revcomp(w)) for i in range(len(seq) - k + 1) if set(w := seq[i : i + k].upper()) <= set("ACGT")}


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    runs = {i: "".join(rng.choices("ACGT", k=rng.randint(0, 300))) for i in range(30)}
    queries = {100 + i: runs[i][10:60] if i % 2 else "".join(rng.choices("ACGTN", k=40)) for i in range(8)} | {200: "ACGTA", 201: "AC", 202: ""}
    return runs, queries, spark.createDataFrame(list(runs.items()), SEQ), spark.createDataFrame(list(queries.items()), SEQ)


def brute(runs, queries, k, t):
    import struct

    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    out = set()
    for q, s in queries.items():
        own = sets(s, k)
        for r, x in runs.items():
            n = len(own & sets(x, k))
            if own and n >= int(f32(f32(t) * len(own))):
                out.add((q, r, len(own), n))
    return out


@pytest.mark.parametrize("t", [1.0, 0.7, 0.3, 0.1])
def test_exact_search(data, t):
    runs, queries, a, b = data
    assert {tuple(r) for r in search.exact(a, b, 5, t).collect()} == brute(runs, queries, 5, t)


def test_threshold_of_zero_matches_all(spark, data):
    runs, _, a, _ = data
    got = search.exact(a, spark.createDataFrame([(1, "ACGTA")], SEQ), 5, 0.5).collect()
    assert {r.run_id for r in got} == set(runs)


def bits_of(rows):
    """{run: set of bits} of postings."""
    out = {}
    for r in rows:
        assert r.bit_pos not in out.setdefault(r.run_id, set())
        out[r.run_id].add(r.bit_pos)
    return out


def plain_filters(runs, params, k):
    from strandwise.functions.hashing import murmur3

    out = {}
    for p in params:
        words = sorted(sets(runs[p.run_id], k))
        rows = np.array([list(w.encode()) for w in words], np.uint8)
        out[p.run_id] = set((murmur3(rows, range(p.num_hash)).astype(np.int64) & ((1 << p.log_2_filter_len) - 1)).ravel().tolist())
    return out


@pytest.mark.parametrize("dense_log", [20, 8])
def test_index_in_all_its_forms(spark, data, dense_log):
    """Filters filled run by run and bit by bit, against plain sets; blocks, slices, pairs, checksums."""
    runs, queries, a, b = data
    k = 7
    counted = kmers.distinct(a, k)
    params = index.run_params(counted, k, 15, 20)
    rows = params.collect()
    want = plain_filters(runs, rows, k)
    built = index.build(counted, params, k, dense_log)
    blocks = index.merged(built).cache()
    assert bits_of(index.postings(blocks).collect()) == want
    both = index.merge(built.where("run_id < 15"), built.where("run_id >= 10"))
    assert bits_of(index.postings(both).collect()) == want
    stored = index.checked(blocks)
    assert index.damaged(stored).count() == 0 and index.damaged(stored.withColumn("crc32", F.col("crc32") + 1)).count() == blocks.count()
    assert all(zlib.crc32(r.bits) == r.crc32 for r in stored.collect())
    for r in index.occupancy(built).collect():
        assert (r.n_set, r.places, r.share) == (len(want[r.run_id]), sum(want[r.run_id]), len(want[r.run_id]) / 2**r.log_2_filter_len)
    ranks = packing.packed(params)
    place = {(r.kmer_len, r.log_2_filter_len, r.num_hash, r.file, r.place): r.run_id for r in ranks.collect()}
    got = {i: set() for i in want}
    for r in index.slices(built, ranks).collect():
        assert len(r.slice) == 256 and any(r.slice)
        for p in range(2048):
            if r.slice[p // 8] >> (p % 8) & 1:
                got[place[r.kmer_len, r.log_2_filter_len, r.num_hash, r.file, p]].add(r.bit_pos)
    assert got == want
    kind = {p.run_id: (p.log_2_filter_len, p.num_hash) for p in rows}
    pairs = spark.createDataFrame([(i, j) for i in kind for j in kind if i < 4], "left_id long, right_id long")
    alike = {(i, j) for i in kind for j in kind if i < 4 and kind[i] == kind[j]}
    assert {(r.left_id, r.right_id): (r.n_left, r.n_right, r.n_both, r.n_differ) for r in index.difference(blocks, pairs).collect()} == {(i, j): (len(want[i]), len(want[j]), len(want[i] & want[j]), len(want[i] ^ want[j])) for i, j in alike}
    sizes = {(r.left_id, r.right_id): tuple(r)[2:] for r in index.combined_sizes(index.folded(blocks, 15), pairs).collect()}
    fold = {i: {x % (1 << 15) for x in s} for i, s in want.items()}
    flat = lambda s: (len(s), sum(s))
    assert sizes == {(i, j): (*flat(fold[i] | fold[j]), *flat(fold[i] & fold[j]), *flat(fold[i] ^ fold[j])) for i in kind if i < 4 for j in kind}


def brute_search(runs, filters, kind, queries, k, t):
    from strandwise.functions.hashing import murmur3

    out = set()
    for q, seq in queries.items():
        own = sorted(sets(seq, k))
        if not own:
            continue
        hashes = murmur3(np.array([list(w.encode()) for w in own], np.uint8), range(5)).astype(np.int64)
        for r, bits in filters.items():
            length, h = kind[r]
            n = sum(all(int(x) in bits for x in row[:h] & ((1 << length) - 1)) for row in hashes)
            if n >= int(np.float32(t) * np.float32(len(own))):
                out.add((q, r, len(own), n))
    return out


@pytest.mark.parametrize("part", [4096, 3])
def test_search_over_slices(spark, data, tmp_path, monkeypatch, part):
    runs, queries, a, b = data
    k = 7
    monkeypatch.setattr(index, "SEARCH_WINDOWS", part)
    counted = kmers.distinct(a, k)
    params = index.run_params(counted, k, 15, 20)
    rows = params.collect()
    filters, kind = plain_filters(runs, rows, k), {p.run_id: (p.log_2_filter_len, p.num_hash) for p in rows}
    ranks = packing.packed(params).cache()
    slices = index.slices(index.build(counted, params, k), ranks)
    index.write_slices(slices, str(tmp_path / "index"))
    stored = index.read_slices(spark, str(tmp_path / "index"))
    assert index.damaged_slices(stored).count() == 0 and stored.count() == slices.count()
    dumped = {(r.log_2_filter_len, r.num_hash, r.bit_pos): r.bits for r in index.dump_slices(stored, 2000).collect()}
    for r in stored.where("bit_pos < 2000").collect():
        assert dumped[r.log_2_filter_len, r.num_hash, r.bit_pos] == "".join(str(r.slice[p // 8] >> (p % 8) & 1) for p in range(2048))
    for t in (1.0, 0.4, 0.05):
        got = {tuple(r) for r in index.search(stored, ranks, b, k, t).collect()}
        assert got == brute_search(runs, filters, kind, queries, k, t)
        assert {(q, r) for q, r, _, n in brute(runs, queries, k, t) if r in kind} <= {(q, r) for q, r, _, _ in got}


def test_least_counts_and_limits(spark):
    seqs = spark.createDataFrame([(1, "ACGACGACG"), (2, None), (3, "ACG"), (4, "")], SEQ)
    assert {(r.id, r.kmer, r.n) for r in kmers.abundant(seqs, 3, 3).withColumn("kmer", dna.decode(F.col("kmer"), 3)).collect()} == {(1, "ACG", 3)}
    assert {r.id for r in kmers.within_limit(kmers.distinct(seqs, 3), 1).collect()} == {3}
    assert {r.id: (r.n_kmers, r.n_distinct) for r in kmers.profile(seqs, 3).collect()} == {1: (7, 3), 2: (0, 0), 3: (1, 1), 4: (0, 0)}


def test_reads(spark):
    rows = [("A", 1, 0, "ACGTTGCA"), ("A", 2, 0, "ACGTTGCA"), ("A", 3, 1, "AAAAAAAA"), ("A", 4, 0, "GGGTTTAC"), ("B", 1, 0, "ACGTTG"), ("B", 2, 0, None)]
    reads = spark.createDataFrame(rows, "accession string, read_index long, read_subindex int, seq string")
    subjects = spark.createDataFrame([(9, "ACGTTGCA")], SEQ)
    got = {(r.accession, r.read_index): r.score for r in search.reads(reads, subjects, 4, 0.8).collect()}
    assert got == {("A", 1): 1.0, ("A", 2): 1.0, ("B", 1): 1.0}
    assert {(r.accession, r.read_index) for r in search.reads(reads, subjects, 4, 0.8, top=1).collect()} == {("A", 1), ("B", 1)}
    assert search.reads(reads, subjects, 4, 0.8, min_length=7).count() == 2
    # a complexity exactly at the limit stays
    half = spark.createDataFrame([("C", 1, 0, "ACACA")], reads.schema)
    assert kmers.filtered_reads(half, 2, min_complexity=0.5).count() == 1


def test_packing(spark):
    params = spark.createDataFrame([(i, 31, 32 if i < 300 else 18, 2) for i in range(2500)], "run_id long, kmer_len int, log_2_filter_len int, num_hash int")
    files = {(r.log_2_filter_len, r.file): r["count"] for r in packing.packed(params).groupBy("log_2_filter_len", "file").count().collect()}
    assert files == {(32, 0): 128, (32, 1): 128, (32, 2): 44, (18, 0): 2048, (18, 1): 152}
    assert packing.merge_plan([("a", 3), ("b", 5), ("c", 9)], 10) == [("b", "a", 8, 0), ("c", "b", 10, 7)]
    # a file that is filled exactly is done
    assert packing.merge_plan([("a", 3), ("b", 7), ("c", 9)], 10) == [("b", "a", 10, 0)]


def test_inventory_edges(spark):
    empty = spark.createDataFrame([], inventory.SCHEMA)
    assert inventory.totals(empty).first().n_runs == 0 and inventory.histogram(empty).count() == 0
    runs = spark.createDataFrame([("R1", 0), ("R2", 5), ("R3", 5), ("R4", 11)], "run_accession string, number_of_bases long").withColumn("number_of_spots", F.col("number_of_bases"))
    t = inventory.totals(runs).first()
    assert (t.smallest_run, t.largest_run, t.n_empty, t.average_bases, t.min_bases) == ("R2", "R4", 1, 5, 5)
    assert {(r.bin, r.n) for r in inventory.histogram(runs, 2).collect()} == {(0, 2), (2, 2)}
    a, b = (spark.createDataFrame([(x,) for x in s], "run_accession string") for s in ("AB", "BC"))
    assert {tuple(r) for r in inventory.diff(a, b).collect()} == {(1, "A"), (2, "C")}
    status = spark.createDataFrame([("A", 1), ("B", 20)], "run_accession string, status int")
    assert {tuple(r) for r in inventory.marked(status, a, 17).collect()} == {("A", 17), ("B", 17)}
    with pytest.raises(ValueError):
        inventory.marked(status, b, 17)
    assert {tuple(r) for r in inventory.retried(status).collect()} == {("A", 1), ("B", 1)}


@pytest.mark.parametrize("k", [1, 2, 5, 11, 16, 31])
def test_window_codes(k):
    rng = random.Random(k)
    seqs = ["".join(rng.choices("ACGTacgtNu", [9] * 4 + [2] * 4 + [1, 1], k=rng.randint(0, 120))) for _ in range(40)] + ["", "A" * k, "ACGT" * 20]
    data = np.frombuffer("".join(seqs).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    for both in (True, False):
        codes, row = dna.window_codes(data, offsets, k, both)
        want = [(r, min(w, revcomp(w)) if both else w) for r, s in enumerate(seqs) for i in range(len(s) - k + 1) if set(w := s[i : i + k].upper()) <= set("ACGT")]
        assert list(zip(row.tolist(), (x.tobytes().decode() for x in dna.letters_of(codes, k)))) == want


def test_inventory_on_disk(spark, tmp_path):
    runs = spark.createDataFrame([(f"R{i}", 5 - i % 3) for i in range(40)], "run_accession string, number_of_bases long")
    inventory.write(runs, str(tmp_path / "i"))
    listed = spark.createDataFrame([("R7",), ("R7",), ("X",)], "run_accession string")
    assert [r.run_accession for r in inventory.lookup(inventory.read(spark, str(tmp_path / "i")), listed).collect()] == ["R7"]
    assert [r.run_accession for r in inventory.by_bases(runs).limit(2).collect()] == ["R11", "R14"]
    status = spark.createDataFrame([("C", 1), ("A", 1), ("B", 14), ("D", 1)], "run_accession string, status int")
    assert [r.run_accession for r in inventory.pending(status, 2).collect()] == ["A", "C"]


def test_an_index_grows_by_files_and_is_found_under_several_paths(spark, data, tmp_path):
    _, _, a, b = data
    k = 7
    counted = kmers.distinct(a, k)
    params = index.run_params(counted, k, 15, 20)
    ranks = packing.packed(params)
    blocks = index.merged(index.build(counted, params, k)).cache()
    want = {tuple(r) for r in index.search(index.slices(blocks, ranks), ranks, b, k, 0.4).collect()}
    # the runs in two halves, each packed by itself, the files of the second numbered on
    low, high = packing.packed(params.where("run_id < 12")), packing.packed(params.where("run_id >= 12")).withColumn("file", F.col("file") + 100)
    index.write_slices(index.slices(blocks, low), str(tmp_path / "one"))
    index.append_slices(index.slices(blocks, high), str(tmp_path / "one"))
    index.write_slices(index.slices(blocks, low), str(tmp_path / "parts" / "a"))
    index.write_slices(index.slices(blocks, high), str(tmp_path / "parts" / "b"))
    both = low.unionByName(high)
    for stored in (index.read_slices(spark, str(tmp_path / "one")), index.read_slices(spark, str(tmp_path / "parts" / "a"), str(tmp_path / "parts" / "b"))):
        assert {tuple(r) for r in index.search(stored, both, b, k, 0.4).collect()} == want and want
