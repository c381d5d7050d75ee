import bisect
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwise.llm import packing
from strandwise.llm.packing import Bins, best_fit, measured, pieces_of


def plain(pieces, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for n, s, c in pieces:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "s": set(), "c": set()})
        bins[i]["left"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_each_piece_goes_to_the_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 33, 64])
    pieces = [(rng.randint(1, capacity), rng.choice([-1, 0, 0, 0, 1, 2, 3]), rng.choice([-1, -1, 0, 1, 2])) for _ in range(400)]
    bins = Bins(capacity)
    # source 3 is known by its key only, like the sources that aren't frequent
    assert [bins.place(n, 1 << s if 0 <= s < 3 else 0, frozenset([-7] * (s == 3) + [c] * (c >= 0))) for n, s, c in pieces] == plain(pieces, capacity)


def test_tokens_and_clusters():
    texts = ["alpha beta", "alpha beta\n", "\nAlpha \t beta", "beta alpha", "", " \n", "alpha", "alphabeta", "ÄB c", "äb C"]
    count, key = measured(pa.array(texts, pa.large_string()))
    assert count.tolist() == [len(t.split()) for t in texts]
    same = {}
    for i, k in enumerate(key.tolist()):
        same.setdefault(k, []).append(i)
    assert sorted(same.values()) == [[0, 1, 2], [3], [4, 5], [6], [7], [8, 9]]


@pytest.mark.parametrize("hot", [512, 2])
def test_many_shards_are_joined_within_the_limits(spark, monkeypatch, hot):
    """9000 pieces in shards of 700: every token is packed once, no limit is broken, and no two bins are left that fit together in one group."""
    monkeypatch.setattr(packing, "HOT_SOURCES", hot)
    rng = random.Random(1)
    rows = [(rng.choice([i, i, i, None]), rng.choice([1, 5, 40, 60, 100, 101, 350]), rng.choice(["a", "a", "a", "b", "c", f"s{i % 900}", None]), rng.choice([1, 2, i + 10, None])) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, t int, source string, c long").repartition(4)
    own = packing.materialize(docs)
    out = best_fit(own, 100, tokens=F.col("t"), cluster=F.col("c"), shard_pieces=700).collect()
    want = sorted((str(d), min(100, t - at), at) for d, t, _, _ in rows for at in range(0, t, 100))
    assert sorted((str(r.doc_id), r.n_tokens, r.first_token) for r in out) == want
    named = {}
    for r in out:
        named.setdefault(r.bin_id, []).append(r)
    by_doc = {d: (s, c) for d, _, s, c in rows if d is not None}
    for rs in named.values():
        ids = [r.doc_id for r in rs if r.doc_id is not None]
        assert sum(r.n_tokens for r in rs) <= 100 and len(set(ids)) == len(ids)
        for part in (0, 1):
            values = [by_doc[i][part] for i in ids if by_doc[i][part] is not None]
            assert len(set(values)) == len(values)
    alone = best_fit(own, 100, tokens=F.col("t"), cluster=F.col("c")).select("bin_id").distinct().count()
    unjoined = best_fit(own, 100, tokens=F.col("t"), cluster=F.col("c"), shard_pieces=700)
    assert alone <= len(named) <= alone * 1.03, (alone, len(named))
    assert unjoined.select("bin_id").distinct().count() == len(named)


def test_equal_rows_are_spread_over_shards(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) doc_id", "'a b c' text", "cast(null as string) source")
    out = best_fit(docs, 8, shard_pieces=500)
    assert out.count() == 3000 and out.select("bin_id").distinct().count() == 3000


def test_nulls_empties_repeats_and_extra_columns(spark):
    rows = [(1, "a b c", "s", "x"), (1, "a b c", "s", "x"), (2, None, "s", "x"), (3, "", None, None), (None, "d e", None, "y"), (4, "w " * 5000, "t", "x"), (5, "  \n ", "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    out = best_fit(docs, capacity=2048).collect()
    assert sorted((str(r.doc_id), r.piece, r.first_token, r.n_tokens) for r in out) == [("1", 0, 0, 3), ("1", 0, 0, 3), ("4", 0, 0, 2048), ("4", 1, 2048, 2048), ("4", 2, 4096, 904), ("None", 0, 0, 2)]
    assert len({r.bin_id for r in out if r.doc_id == 1}) == 2
    assert best_fit(docs.limit(0)).count() == 0


def test_a_corpus_of_one_shard_is_packed_as_by_looking_at_every_bin(spark):
    """24,000 documents, some without doc_id, source or cluster: the bins are those of the brute-force packer over all."""
    rng = random.Random(4)
    rows = [(i if i % 10 else None, rng.choice([1, 3, 7, 8, 13, 20, 45]), rng.choice("abcdefgh") if rng.random() < 0.9 else None, rng.randint(0, 9000) if rng.random() < 0.8 else None) for i in range(24_000)]
    docs = spark.createDataFrame(rows, "doc_id long, t int, source string, c long").repartition(6)
    got = best_fit(docs, 16, tokens=F.col("t"), cluster=F.col("c")).collect()
    order = pieces_of(docs, 16, F.col("t"), F.col("c")).collect()
    order.sort(key=lambda r: (-r.n, r.doc is None, r.doc or 0, r.piece, r.source or "", r["keys"]))
    assert sorted(r.n for r in order) == sorted(min(16, t - at) for _, t, _, _ in rows for at in range(0, t, 16))
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r.n_tokens)
    assert all(sum(b) <= 16 for b in bins.values())
    want = {}
    for r, b in zip(order, plain_by_residual([(r.n, r.source, r["keys"][0] if r["keys"] else None) for r in order], 16)):
        want.setdefault(b, []).append((r.doc, r.piece, r.n))
    have = {}
    for r in got:
        have.setdefault(r.bin_id, []).append((r.doc_id, r.piece, r.n_tokens))
    key = lambda b: sorted(b, key=str)
    assert sorted(map(key, have.values()), key=str) == sorted(map(key, want.values()), key=str)


def plain_by_residual(pieces, capacity):
    """Best fit by looking at the bins of each residual in turn, in the order of opening."""
    at, held, out = [[] for _ in range(capacity + 1)], [], []
    for n, s, c in pieces:
        hit = next(((r, b) for r in range(n, capacity + 1) for b in at[r] if (s is None or s not in held[b][0]) and (c is None or c not in held[b][1])), None)
        if hit is None:
            hit = capacity, len(held)
            held.append((set(), set()))
        else:
            at[hit[0]].remove(hit[1])
        r, b = hit
        held[b][0].add(s)
        held[b][1].add(c)
        if r > n:
            bisect.insort(at[r - n], b)
        out.append(b)
    return out


def test_near_copies_share_no_bin(spark):
    from strandwise.llm.simhash import near_groups

    rng = random.Random(6)
    rows = []
    for g in range(30):
        words = [f"{rng.choice('bcdf')}{rng.randint(0, 99999)}" for _ in range(60)]
        rows += [(g * 10 + c, " ".join(w if c == 0 or rng.random() > 0.03 else "x" + w for w in words), f"s{g}-{c}") for c in range(4)]
    docs = packing.materialize(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    groups = near_groups(docs)
    root = {r.id: r.root for r in groups.collect()}
    assert len(root) == 120
    bins = {}
    for r in best_fit(docs, groups=groups).collect():
        bins.setdefault(r.bin_id, []).append(root[r.doc_id])
    assert all(len(set(b)) == len(b) for b in bins.values()) and len(bins) == 4
    alone = {}
    for r in best_fit(docs).collect():
        alone.setdefault(r.bin_id, []).append(root[r.doc_id])
    assert any(len(set(b)) < len(b) for b in alone.values())
