import itertools

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandwise.llm import quality as Q
from strandwise.llm.crf import fit, forward_backward, viterbi

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(6))
def test_chain_equals_enumeration(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 5, 6)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    unary, trans = rng.normal(size=(offsets[-1], 3)), rng.normal(size=(3, 3))
    marginals, pairs, total = forward_backward(unary, trans, offsets)
    path = viterbi(unary, trans, offsets)
    want_pairs, want_total = np.zeros((3, 3)), 0.0
    for lo, hi in zip(offsets, offsets[1:]):
        ways = list(itertools.product(range(3), repeat=hi - lo))
        score = np.array([sum(unary[lo + i, s] for i, s in enumerate(w)) + sum(trans[a, b] for a, b in zip(w, w[1:])) for w in ways])
        p = np.exp(score) / np.exp(score).sum()
        want_total += np.log(np.exp(score).sum())
        for w, q in zip(ways, p):
            for i, s in enumerate(w):
                marginals[lo + i, s] -= q
            for a, b in zip(w, w[1:]):
                want_pairs[a, b] += q
        assert tuple(path[lo:hi]) == ways[int(score.argmax())]
    assert np.allclose(marginals, 0, atol=1e-9) and np.allclose(pairs, want_pairs) and np.isclose(total, want_total)


def test_fit_raises_the_likelihood():
    rng = np.random.default_rng(0)
    offsets = np.arange(0, 401, 10)
    states = np.repeat(rng.integers(0, 2, 200), 2)
    x = np.eye(2)[states] + rng.normal(size=(400, 2))
    w, t = fit(lambda w: x @ w, lambda g: x.T @ g, (2, 2), states, offsets, steps=500, l2=0)
    inner = np.flatnonzero(np.arange(400) % 10)

    def likelihood(w, t):
        return (x @ w)[np.arange(400), states].sum() + t[states[inner - 1], states[inner]].sum() - forward_backward(x @ w, t, offsets)[2]

    best = likelihood(w, t)
    assert best > likelihood(0 * w, 0 * t) + 50
    for _ in range(20):
        assert best > likelihood(w + rng.normal(size=w.shape) * 0.3, t + rng.normal(size=t.shape) * 0.3)


def test_line_features_are_those_of_each_line_alone():
    texts = ["Ab cd\n\nXX!! 12 12", "", "\n", "one two three four one two three\n", "é|ü"]
    features, size, offsets = Q.line_features(pa.array(texts, pa.large_string()))
    lines = [t.split("\n") for t in texts]
    assert np.diff(offsets).tolist() == [len(x) for x in lines]
    flat = [x for t in lines for x in t]
    assert size.tolist() == [len(x.encode()) for x in flat]
    for f, x in zip(features, flat):
        n = max(1, len(x.encode()))
        assert np.isclose(f[0], sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in x) / n) and np.isclose(f[1], sum(c in "0123456789" for c in x) / n) and np.isclose(f[4], x.count("!") / n)
    assert features[2][5] == 1 / 3 and features[6][6] > 0
    assert (features[1, Q.N_FEATURES : 2 * Q.N_FEATURES] == features[0, : Q.N_FEATURES]).all() and (features[0, Q.N_FEATURES : 2 * Q.N_FEATURES] == 0).all()


def test_held_out_accuracy():
    docs, labels = pq.read_table(f"{DATA}/documents.parquet").to_pandas(), pq.read_table(f"{DATA}/labels.parquet").to_pandas()
    rows = docs.merge(labels, on="doc_id").sample(frac=1, random_state=0)
    train, test = rows[:200], rows[200:]
    field = Q.train(list(train.text), list(train.quality))
    good = field.quality(pa.array(list(test.text), pa.large_string())) >= Q.GOOD_FROM
    truth = test.quality.to_numpy() == 1
    assert good[truth].mean() > 0.98 and good[~truth].mean() < 0.2


def test_cases(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", "text", "lang id", "1 body", "'x' quality")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    odd = [(-1, None), (-2, ""), (-3, "\n\n"), (None, "Some plain words here."), (-4, "Plain words again and more of them.\n" * 3000), (-5, "THE!! THE!! THE!! THE!!\n" * 20), (-5, "THE!! THE!! THE!! THE!!\n" * 20), (-6, "x" * 300_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "'i' id", "2 body", "'y' quality"))
    out = {r.doc_id: r for r in Q.scores(docs, labels).collect()}
    assert [out[i].quality for i in (-1, -2, -3)] == [0.0] * 3 and not out[-5].good and out[0].good
    kept = Q.keep_good(docs, labels)
    assert kept.dtypes == docs.dtypes and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in Q.scores(docs, labels).collect() if r.good)
    none = Q.scores(docs, labels.limit(0)).collect()
    assert all(r.quality == (0.0 if r.doc_id in (-1, -2, -3) else 1.0) for r in none)
    assert Q.scores(docs.limit(0), labels).count() == 0


def test_query_equals_plain_sums_over_all_labellings(spark):
    """Each document by itself: messages in logarithms, line after line."""
    import math

    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    field = Q.fitted(docs, labels)
    add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    got = {r.doc_id: r for r in Q.query(spark, path).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc, text in rows:
        features, size, _ = Q.line_features(pa.array([text], pa.large_string()))
        unary, move = (features @ field.weights).tolist(), field.transitions.tolist()
        ahead, back = [unary[0]], [[0.0, 0.0]]
        for u in unary[1:]:
            ahead.append([u[s] + add([ahead[-1][a] + move[a][s] for a in (0, 1)]) for s in (0, 1)])
        for u in unary[:0:-1]:
            back.insert(0, [add([move[s][b] + u[b] + back[0][b] for b in (0, 1)]) for s in (0, 1)])
        p = [math.exp(a[1] + b[1] - add([a[0] + b[0], a[1] + b[1]])) for a, b in zip(ahead, back)]
        want = sum(x * n for x, n in zip(p, size)) / sum(size) if sum(size) else 0.0
        assert abs(got[doc].quality - want) < 1e-9 and got[doc].good == (want >= Q.GOOD_FROM)
        assert len(got[doc].lines) == len(text.split("\n")) and all(abs(x - 0.5) < 1e-9 or y == (x >= 0.5) for x, y in zip(p, got[doc].lines))


def test_junk_stretches_are_found_line_by_line():
    docs, labels = pq.read_table(f"{DATA}/documents.parquet").to_pandas(), pq.read_table(f"{DATA}/labels.parquet").to_pandas()
    rows = docs.merge(labels, on="doc_id").drop_duplicates("doc_id").sample(frac=1, random_state=0)
    train, test = rows[:200], rows[200:]
    field = Q.train(list(train.text), list(train.quality))
    texts, states = Q._spliced(list(test.text), list(test.quality), seed=99)
    good, size, offsets = field.lines(pa.array(texts, pa.large_string()))
    truth = np.concatenate(states) == 1
    right = ((good >= 0.5) == truth)[size > 20]
    assert right.mean() > 0.9
    halves = Q.weighted(good, size, offsets)
    want = Q.weighted(truth.astype(float), size, offsets)
    assert np.abs(halves - want).mean() < 0.1
    # whole junk documents: how many are caught
    kept = field.quality(pa.array(list(test[test.quality == 0].text), pa.large_string())) >= Q.GOOD_FROM
    assert kept.mean() <= 0.1


def test_a_megabyte_of_line_breaks_is_judged_in_seconds():
    import time

    docs, labels = pq.read_table(f"{DATA}/documents.parquet").to_pandas(), pq.read_table(f"{DATA}/labels.parquet").to_pandas()
    rows = docs.merge(labels, on="doc_id")[:100]
    field = Q.train(list(rows.text), list(rows.quality))
    for text in ("\n" * 1_000_000, "A!!\n" * 250_000, "x" * 1_000_000):
        began = time.time()
        field.quality(pa.array([text], pa.large_string()))
        assert time.time() - began < 6
