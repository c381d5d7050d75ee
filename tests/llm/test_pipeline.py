"""The pipeline against a version that judges every document and every pair by itself."""

import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandwise.llm import decontaminate, packing, quality, simhash

DATA = "/root/testdata/sf0.001"


def brute(docs, labels, items):
    field = quality.fitted(docs, labels)
    rows = [r for r in docs.collect() if r.text and field.quality(pa.array([r.text], pa.large_string()))[0] >= quality.GOOD_FROM]
    best = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        best.setdefault(r.text, r)
    rows = list(best.values())
    # SimHash: all pairs, whatever buckets they fall into
    prints = [simhash.fingerprints(pa.array([r.text], pa.large_string()))[0] for r in rows]
    bits = [np.unpackbits(p.view(np.uint8)) if len(p) else None for p in prints]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bits[i] is not None and bits[j] is not None and (bits[i] != bits[j]).sum() <= simhash.RADIUS:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    rows = [r for i, r in enumerate(rows) if root(i) == i]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    leaked = set()
    for item in items.collect():
        p = words(item.text)
        for r in rows:
            t = words(r.text)
            seeds = {tuple(p[i : i + 3]) for i in range(len(p) - 2)}
            if any(tuple(t[i : i + 3]) in seeds for i in range(len(t) - 2)):
                pairs = [(i, j) for i in range(len(p) - 2) for j in range(len(t) - 2) if p[i : i + 3] == t[j : j + 3]]
                if decontaminate.tiled(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), 3) >= decontaminate.THRESHOLD * len(p):
                    leaked.add(r.doc_id)
    return {r.doc_id: r for r in rows if r.doc_id not in leaked}


def test_run_equals_brute_force(spark):
    table = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    docs = table("documents")
    want = brute(docs, table("labels"), table("benchmark"))
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in out} == set(want)
    tokens = {}
    for r in out:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {i: len(r.text.split()) for i, r in want.items()}
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r)
    for rows in bins.values():
        assert sum(r.n_tokens for r in rows) <= packing.CAPACITY
        assert len({want[r.doc_id].source for r in rows}) == len(rows)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).dtypes == docs.dtypes


@pytest.mark.parametrize("rows", [0, 1])
def test_stages_take_nulls_extra_columns_and_empty_tables(spark, rows):
    odd = [(None, None, None, None, None, None), (1, None, "en", "s", 0, 1), (1, "", "en", None, 0, 1), (2, "Plain words of some kind.", None, "s", 5, 2), (2, "Plain words of some kind.", None, "s", 5, 2), (3, "w " * 100_000, "en", "s", 5, 3)]
    docs = spark.createDataFrame(odd * rows, "doc_id long, text string, lang string, source string, n_chars long, id long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        docs.collect()
    assert {r.doc_id for r in docs.collect()} <= {2, 3}
