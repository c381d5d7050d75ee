"""Queries over all consecutive pairs, held against plain sets."""

import duckdb

from strandwise.plans import registry
from strandwise.plans.base import K, seq_sql

DATA = "/root/testdata/sf0.001"


def windows():
    """The canonical windows of every benchmark item, cut in plain Python."""
    back = str.maketrans("ACGT", "TGCA")
    rows = duckdb.connect().execute(seq_sql(f"'{DATA}/benchmark.parquet'", "item_id")).fetchall()
    return {i: {min(w, w.translate(back)[::-1]) for w in (s[a : a + K] for a in range(len(s) - K + 1))} for i, s in rows}


def test_every_item_meets_the_next_one(spark):
    sets = windows()
    want = {(i, i + 1, len(own & sets.get(i + 1, set()))) for i, own in sets.items() if own}
    assert any(i % 2 for i, _, _ in want)
    assert {tuple(r) for r in registry.QUERIES["kmer_set_pairs"](spark, DATA).select("left_id", "right_id", "n_both").collect()} == want


def test_no_document_is_left_out(spark):
    ids = {i for (i,) in duckdb.connect().execute(f"SELECT DISTINCT id FROM ({seq_sql(f"'{DATA}/documents.parquet'", 'doc_id')}) WHERE length(seq) >= {K}").fetchall()}
    got = registry.QUERIES["filter_union"](spark, DATA).select("left_id").collect()
    assert sorted(r.left_id for r in got) == sorted(i for i in ids if i + 1 in ids) and len(got) > 100
