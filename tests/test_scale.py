"""Plans over whole tables: what is worked out where a row is read, and sequences that come in several rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwise.functions import dna
from strandwise.operators import index, kmers, search

SEQ = "id long, seq string"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def windows_of(seq, k):
    both = lambda w: min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))
    return [both(seq[i : i + k]) for i in range(len(seq) - k + 1) if set(seq[i : i + k]) <= set("ACGT")]


def some_rows(n, ids, seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice(ids), "".join(rng.choice("ACGTN" if rng.random() < 0.05 else "ACGT") for _ in range(rng.randrange(0, 90)))) for _ in range(n)]
    return [*rows, (None, "ACGTACG"), (None, "ACGTTTT"), (-7, None)]


def counts_of(rows, k):
    out = {}
    for i, seq in rows:
        out.setdefault(i, Counter()).update(windows_of(seq or "", k))
    return out


def test_windows_of_a_sequence_in_one_row_are_not_shuffled(spark):
    seqs = spark.createDataFrame([(i, "ACGTAC" * i) for i in range(1, 9)], SEQ)
    for df in (kmers.summary(seqs, 5), kmers.profile(seqs, 5), kmers.distinct(seqs, 5), kmers.abundant(seqs, 5, 2), index.params_of(seqs, 5)):
        assert exchanges(df) == 0


@pytest.mark.parametrize("joined", [kmers.JOINED_LETTERS, 120, 0])
@pytest.mark.parametrize("k", [5, 31])
def test_sequences_in_several_rows(spark, monkeypatch, joined, k):
    monkeypatch.setattr(kmers, "JOINED_LETTERS", joined)
    rows = some_rows(40, list(range(12)) + list(range(100, 130)))
    want = counts_of(rows, k)
    seqs = spark.createDataFrame(rows, SEQ)
    got = kmers.counted(seqs, k).withColumn("kmer", dna.decode(F.col("kmer"), k)).collect()
    assert Counter({(r.id, r.kmer): r.n for r in got}) == Counter({(i, w): n for i, c in want.items() for w, n in c.items()}) and len(got) == sum(map(len, want.values()))
    letters = Counter()
    for i, seq in rows:
        letters[i] += len(seq or "")
    sums = kmers.summary(seqs, k).withColumns({c: dna.decode(F.col(c), k) for c in ("least", "most")}).collect()
    assert {r.id: tuple(r)[1:] for r in sums} == {i: (letters[i], sum(c.values()), len(c), min(c, default=None), max(c, default=None)) for i, c in want.items()} and len(sums) == len(want)


@pytest.mark.parametrize("held", [search.HELD_WINDOWS, 3])
@pytest.mark.parametrize("joined", [kmers.JOINED_LETTERS, 0])
@pytest.mark.parametrize("k", [5, 13])
def test_exact_search(spark, monkeypatch, held, joined, k):
    monkeypatch.setattr(kmers, "JOINED_LETTERS", joined)
    monkeypatch.setattr(search, "HELD_WINDOWS", held)
    rows, asked = some_rows(30, list(range(9)) + list(range(100, 120))), some_rows(9, list(range(40, 46)), 6)
    rows += [(200, asked[0][1]), (201, asked[1][1] + "N" + asked[2][1])]
    a, b = counts_of(rows, k), {i: c for i, c in counts_of([r for r in asked if r[0] is not None and r[0] > 0], k).items() if c}
    got = search.exact(spark.createDataFrame(rows, SEQ).where("id is not null"), spark.createDataFrame(asked, SEQ).where("id > 0"), k, 0.3).collect()
    want = {(q, r, len(own), len(own.keys() & c.keys())) for q, own in b.items() for r, c in a.items() if r is not None and len(own.keys() & c.keys()) >= int(len(own) * 0.3)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_windows_are_looked_up_where_a_run_is_read(spark):
    runs = spark.createDataFrame([(i, "ACGTAC" * i) for i in range(1, 9)], SEQ)
    wanted = search.query_sets(runs, 5)
    assert exchanges(search.shared(runs, wanted, 5, 0.5)) == 0


@pytest.mark.parametrize("joined", [kmers.JOINED_LETTERS, 0])
@pytest.mark.parametrize("file_log", [index.FILE_LOG, 15, 14])
def test_filters_from_texts_are_the_stored_ones(spark, monkeypatch, joined, file_log):
    from strandwise.operators import packing

    monkeypatch.setattr(kmers, "JOINED_LETTERS", joined)
    monkeypatch.setattr(index, "FILE_LOG", file_log)
    rng, k, limits = random.Random(3), 11, (15, 17)
    rows = some_rows(30, list(range(9)) + list(range(100, 120)))
    rows += [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in ((10, 9000), (11, 9000), (12, 20000), (12, 9000))]
    seqs, queries = spark.createDataFrame(rows, SEQ), spark.createDataFrame([(1, rows[-1][1][:80]), (2, rows[-2][1][:300]), (3, rows[5][1]), (4, "ACG")], SEQ)
    params = index.run_params(kmers.windows(seqs, k).distinct(), k, *limits)
    assert {tuple(r) for r in index.params_of(seqs, k, *limits).collect()} == {tuple(r) for r in params.collect()}
    ranks = packing.packed(params).cache()
    stored = index.merged(index.build(kmers.windows(seqs, k).distinct(), ranks, k)).cache()
    assert stored.select("log_2_filter_len").distinct().count() > 1
    plain = lambda df, columns=None: sorted(map(tuple, df.select(columns or df.columns).collect()))
    columns = ["run_id", *index.PARAMS, "block", "bits"]
    own = index.blocks_of(seqs, k, *limits)
    assert plain(own, columns) == plain(stored, columns)
    assert plain(index.occupied(own)) == plain(index.occupancy(stored))
    pairs = spark.createDataFrame([(i, j) for i in (0, 1, 10, 11, 12, 100) for j in (1, 2, 11, 12, 999)], "left_id long, right_id long")
    assert plain(index.differences(seqs, pairs, k, *limits)) == plain(index.difference(stored, pairs))
    want = index.combined_sizes(index.folded(stored, 15), pairs)
    assert plain(index.pair_sizes(seqs, pairs, k, 15, *limits), want.columns) == plain(want)
    slices = index.slices(stored, ranks)
    assert plain(index.slices_of(seqs, ranks, k)) == plain(slices) and plain(index.slices_of(seqs, ranks, k, 99)) == plain(slices.where("bit_pos < 99"))
    for most in (index.QUERY_WINDOWS, 5):
        monkeypatch.setattr(index, "QUERY_WINDOWS", most)
        for threshold in (0.3, 1.0):
            assert plain(index.search_runs(seqs, ranks, queries, k, threshold)) == plain(index.search(slices, ranks, queries, k, threshold))


@pytest.mark.parametrize("k", [1, 3, 4, 5, 8, 11, 13, 31])
def test_hashes_of_windows_by_table(k):
    import numpy as np

    from strandwise.functions import hashing

    codes = np.random.default_rng(k).integers(0, 4**k, 500)
    assert (hashing.murmur3_windows(codes, k, range(5), 77) == hashing.murmur3(dna.letters_of(codes, k), range(5))).all()
