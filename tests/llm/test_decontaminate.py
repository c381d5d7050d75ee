import random

import numpy as np
import pyarrow as pa
import pytest

from strandwise.llm import decontaminate as D


def plain_tiling(pattern, text, least):
    """Greedy string tiling as first published: search everything again for each longest match."""
    in_p, in_t = [False] * len(pattern), [False] * len(text)
    while True:
        best = None
        for t in range(len(text)):
            for p in range(len(pattern)):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and not in_p[p + k] and not in_t[t + k]:
                    k += 1
                if k >= least and (best is None or (-k, p, t) < best):
                    best = (-k, p, t)
        if best is None:
            return sum(in_p)
        k, p, t = best
        for j in range(-k):
            in_p[p + j] = in_t[t + j] = True


@pytest.mark.parametrize("seed", range(25))
def test_coverage_equals_plain_tiling(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([3, 8, 40]))]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for _ in range(4)]
    texts = []
    for _ in range(6):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(words))
            item = rng.choice(items)
            cut = rng.randint(0, len(item))
            words[at:at] = item[cut:] + item[:cut]
        texts.append(words)
    index = D.Index(list(range(4)), [" ".join(i) for i in items], 3)
    for threshold in (1e-9, 0.4):
        got = {(r, i): c for r, i, c in D.coverages(index, pa.array([", ".join(t) for t in texts], pa.large_string()), threshold)}
        want = {(r, i): plain_tiling(item, t, 3) / len(item) for r, t in enumerate(texts) for i, item in enumerate(items)}
        assert got == {k: c for k, c in want.items() if c >= threshold and c > 0}


def test_tables(spark):
    rng = random.Random(2)
    w = lambda n: [f"x{rng.randint(0, 99999)}" for _ in range(n)]
    a, b = w(30), w(24)
    rows = [
        (1, " ".join(w(50) + a + w(50)), 0),
        (2, ". ".join(w(50) + a[20:] + w(3) + a[10:20] + a[:10]).upper(), 0),
        (3, " ".join(w(40) + a[:9]), 0),
        (4, None, 0),
        (5, "", 0),
        (6, " ".join(w(30000) + b), 0),
        (6, " ".join(b), 1),
        (None, " ".join(b), 2),
        (None, "clean text", 3),
        (7, "tiny one", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, coverage int").repartition(3)
    bench = spark.createDataFrame([(10, " ".join(a)), (11, " ".join(b)), (11, " ".join(b)), (12, None), (13, "tiny one"), (14, "")], "item_id long, text string")
    for limit in (D.INDEX_BYTES, 40):
        found = {(r.doc_id, r.item_id): r.coverage for r in D.leaks(docs, bench, index_bytes=limit).collect()}
        assert found == {(1, 10): 1.0, (2, 10): 1.0, (6, 11): 1.0, (None, 11): 1.0}
        kept = D.clean(docs, bench, index_bytes=limit)
        assert kept.dtypes == docs.dtypes
        assert sorted((str(r.doc_id), r.coverage) for r in kept.collect()) == [("3", 0), ("4", 0), ("5", 0), ("7", 0), ("None", 3)]
    assert D.leaks(docs, bench.limit(0)).count() == 0 and D.clean(docs, bench.limit(0)).count() == len(rows)
    assert D.leaks(docs.limit(0), bench).count() == 0


def test_hits_are_all_equal_windows():
    index = D.Index([0, 1], ["a b c d a b c", "b c d"], 3)
    hashes, rows = D.words(pa.array(["a b c d", "b c"], pa.large_string()))
    at, item, item_at = index.hits(hashes, rows)
    assert sorted(zip(at.tolist(), item.tolist(), item_at.tolist())) == [(0, 0, 0), (0, 0, 4), (1, 0, 1), (1, 1, 0)]
    assert isinstance(at, np.ndarray)


def test_typographic_signs_split_words_like_plain_ones(spark):
    plain = "the cat sat on the mat and then the dog ran off with it all"
    curly = "“the cat” sat—on the mat ‘and then’ the dog… ran off «with it» all"
    wide = "我们昨天去了北京的天安门广场看升旗"
    docs = spark.createDataFrame([(1, curly), (2, plain.upper()), (3, "是的，" + wide + "。后来"), (4, "the cat’s mat")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, plain), (2, curly), (3, wide)], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.coverage) for r in D.leaks(docs, bench).collect()} == {(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)}
    assert len(D.words(pa.array(["a·b", "né µm ª1", "a　b、c", "Ａ！ｂ"], pa.large_string()))[0]) == 2 + 3 + 3 + 2
