import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandwise.llm import pii as P
from strandwise.llm.crf import forward_backward, viterbi
from strandwise.llm.pii_table import TAGS, labelled_lines, split_words


def shape(word, fold):
    out = ""
    for c in word:
        k = "9" if c in "0123456789" else ("a" if fold or not ("A" <= c <= "Z") else "A") if c.isalpha() else c
        out += "" if out.endswith(k) else k
    return out


def test_features_are_those_of_each_word():
    rng = random.Random(0)
    lines = [t for t, _ in labelled_lines(80, seed=9)]
    texts = ["\n".join(rng.choices(lines, k=rng.randint(0, 4))) for _ in range(30)] + ["", "...", "a\n\n!! b(c", "Tel:7 x:y;ab:cd,|é:1:2 z:", ":9:"]
    w = P.words(pa.array(texts, pa.large_string()))
    raw = [t.encode() for t in texts]
    found = [raw[0]]
    base = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    found = [raw[r][lo - base[r] : hi - base[r]].decode() for r, lo, hi in zip(w.rows, w.starts, w.ends)]
    flat = [split_words(line) for t in texts for line in t.split("\n")]
    assert np.diff(w.offsets).tolist() == [len(x) for x in flat if x]
    for column, key in ((0, lambda x: shape(x, False)), (1, lambda x: shape(x, True))):
        by_key = {}
        for word, value in zip(found, w.features[:, column]):
            assert by_key.setdefault(key(word), value) == value
        assert len(set(by_key.values())) == len(by_key)
    assert w.features[:, 2].tolist() == [min(40, sum(c in "0123456789" for c in x)) for x in found]
    at = 0
    for line in (x for x in flat if x):
        own = w.features[at : at + len(line)]
        assert own[0, 5] == 0 and own[-1, 6] == 0 and (own[1:, 5] == own[:-1, 1]).all() and (own[:-1, 6] == own[1:, 1]).all()
        at += len(line)


def test_fast_scores_equal_the_sum_of_weights():
    model = P.tagger()
    w = P.words(pa.array([t for t, _ in labelled_lines(200, seed=11)], pa.large_string()))
    plain = sum(weights[P._number(c, known)] for c, known, weights in zip(w.features.T, model.known, model.weights))
    assert (viterbi(plain, model.transitions, w.offsets) == model.tags(w)).all()


def test_held_out_accuracy():
    rows = labelled_lines(400, seed=77)
    w = P.words(pa.array([t for t, _ in rows], pa.large_string()))
    truth = np.array([TAGS.index(t) for _, tags in rows for t in tags])
    tags = P.tagger().tags(w)
    assert (tags[truth > 0] == truth[truth > 0]).mean() > 0.97 and (tags[truth == 0] > 0).mean() < 0.01


def test_spans_and_checksums():
    model = P.tagger()
    text = "Call +1 (040) 555-0631!! or\nmail Thé.02@mail1.example.com, card 4556737586899855. not 4556737586899856 ip 10.0.300.1 but 8.8.4.4%%% version 3.0. on 2024-01-05"
    got = [(k, v) for _, k, lo, hi, v in P.find(model, pa.array([text], pa.large_string())) if text[lo:hi] == v]
    assert got == [("PHONE", "+1 (040) 555-0631"), ("EMAIL", "Thé.02@mail1.example.com"), ("CARD", "4556737586899855"), ("IP", "8.8.4.4")]


def test_tables(spark):
    filler = "plain words " * 40_000
    rows = [(1, None), (2, ""), (None, "at 8.8.4.4 now"), (3, filler + "7.8.4.4"), (4, "x" * 400_000 + " 9.8.4.4"), (5, "7.7.7.7"), (5, "7.7.7.7"), (6, "\n\n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 id", "'b' body", "'k' kind")
    got = sorted((str(r.doc_id), r.kind, r.begin, r.value) for r in P.personal_data(docs).collect())
    assert got == [("3", "IP", len(filler), "7.8.4.4"), ("4", "IP", 400_001, "9.8.4.4"), ("5", "IP", 0, "7.7.7.7"), ("5", "IP", 0, "7.7.7.7"), ("None", "IP", 3, "8.8.4.4")]
    assert P.personal_data(docs.limit(0)).count() == 0


def test_result_does_not_depend_on_slices():
    batch = pq.read_table("/root/testdata/sf0.001/documents.parquet").combine_chunks().to_batches()[0]
    from strandwise.llm.common import slices

    model = P.tagger()
    results = []
    for limit in (1, 10_000, 1 << 30):
        at, found = 0, []
        for cut, texts in slices(batch, "text", limit):
            found += [(at + r, *rest) for r, *rest in P.find(model, texts)]
            at += cut.num_rows
        results.append(found)
    assert results[0] == results[1] == results[2] and len(results[0]) > 5


@pytest.mark.parametrize(
    "text,want",
    [
        ("4556 7375 8689 9855", [("CARD", "4556 7375 8689 9855")]),
        ("on 12 3782-822463-10005.", [("CARD", "3782-822463-10005")]),
        ("DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432", [("IBAN", "DE89 3704 0044 0532 0130 00"), ("IBAN", "GB82WEST12345698765432")]),
        ("call 555.123.4567 or 555 123 4567", [("PHONE", "555.123.4567"), ("PHONE", "555 123 4567")]),
        ("+44 20 7946 0958", [("PHONE", "+44 20 7946 0958")]),
        ("mailto:jane@x.org", [("EMAIL", "jane@x.org")]),
        ("a@b.com,c@d.org;8.8.4.4,1.2.3.4:80", [("EMAIL", "a@b.com"), ("EMAIL", "c@d.org"), ("IP", "8.8.4.4"), ("IP", "1.2.3.4")]),
        ("“jane@x.org” 2001:db8::8a2e:370:7334", [("EMAIL", "jane@x.org"), ("IP", "2001:db8::8a2e:370:7334")]),
        ("000-00-0000 4556 7375 8689 9856 DE88 3704 0044 0532 0130 00 256.1.1.1", []),
        ("at 12:30:45 on 2024-01-05 v1.2.3 id 978-3-16-148410-0 1 234 567 00:1a:2b:3c:4d:5e", []),
        ("8.8.4." + "5" * 5000 + " DE89" + "1" * 5600 + " ²²²-²²-²²²² " + "9" * 5000, []),
    ],
)
def test_printed_formats(text, want):
    assert [(k, v) for _, k, lo, hi, v in P.find(P.tagger(), pa.array([text], pa.large_string())) if text[lo:hi] == v] == want


@pytest.mark.parametrize("part", ["8.8.4.4 ", "8.8.4.4,", "4556 7375 8689 9855 ", "DE89 ", "a@b.c:", ":", "1111 ", "5", "x@", "é 8.8.4.4\n", "\n"])
def test_a_megabyte_of_anything_is_decoded_in_seconds(part):
    text = part * (1_000_000 // len(part.encode()))
    model = P.tagger()
    began = time.time()
    found = list(P.find(model, pa.array([text], pa.large_string())))
    assert time.time() - began < 6 and all(text[lo:hi] == v for _, _, lo, hi, v in found[-3:])
    assert len(found) == (text.count("8.8.4.4") if "8.8" in part else len(found))


@pytest.mark.parametrize("seed", range(4))
def test_pieces_of_long_sequences_change_nothing(seed):
    rng = np.random.default_rng(seed)
    offsets = np.concatenate([[0], np.cumsum(rng.integers(0, 50, 7))])
    unary, trans = 3 * rng.normal(size=(offsets[-1], 4)), 2 * rng.normal(size=(4, 4))
    want = forward_backward(unary, trans, offsets, most=10_000)
    for most in (1, 2, 7):
        assert (viterbi(unary, trans, offsets, most) == viterbi(unary, trans, offsets, most=10_000)).all()
        got = forward_backward(unary, trans, offsets, most)
        assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1]) and np.isclose(got[2], want[2])


def test_query_reports_what_plain_decoding_finds(spark):
    """Every line decoded by itself, word by word, over the whole table."""
    model = P.tagger()
    path = "/root/testdata/sf0.001/documents.parquet"
    want = set()
    for doc, text in pq.read_table(path, columns=["doc_id", "text"]).to_pandas().itertuples(index=False):
        at = 0
        for line in text.split("\n"):
            want |= {(doc, k, at + lo, at + hi, v) for _, k, lo, hi, v in P.find(model, pa.array([line], pa.large_string()))}
            w = P.words(pa.array([line], pa.large_string()))
            unary = sum(weights[P._number(c, known)] for c, known, weights in zip(w.features.T, model.known, model.weights))
            score = None
            back = []
            for row in np.asarray(unary):
                ways = row[None, :] if score is None else score[:, None] + model.transitions + row[None, :]
                back.append(ways.argmax(axis=0))
                score = ways.max(axis=0)
            tags = []
            if score is not None:
                tags = [int(score.argmax())]
                for b in back[:0:-1]:
                    tags.insert(0, int(b[tags[0]]))
            assert tags == model.tags(w).tolist()
            at += len(line) + 1
    assert {tuple(r) for r in P.query(spark, "/root/testdata/sf0.001").collect()} == want and want
