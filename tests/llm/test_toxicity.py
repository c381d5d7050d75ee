import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandwise.llm import toxicity as T

INSULTS = ["moron", "idiot", "stupid", "pathetic"]


def made(n: int, seed: int) -> tuple[list[str], list[int]]:
    rng = random.Random(seed)
    words = ["".join(rng.choices(["ba", "ko", "ri", "tel", "mun", "sha", "ven"], k=rng.randint(1, 4))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=12)) + "." for _ in range(rng.randint(1, 5))]
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            lines.append(f"you {rng.choice(INSULTS)} {rng.choice(words)}.")
        texts.append(" ".join(lines))
    return texts, toxic


@pytest.fixture(scope="module")
def machine():
    return T.train(*made(400, 1))


def test_kernel_equals_enumeration():
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 7))).encode() for _ in range(12)]

    def weights(w):
        out = {}
        for at in itertools.combinations(range(len(w)), T.ORDER):
            u = tuple(w[i] for i in at)
            out[u] = out.get(u, 0) + T.DECAY ** (at[-1] - at[0] + 1)
        return out

    got = T.subsequence_kernel(T.matrix(words), T.matrix(words))
    want = [[sum(v * weights(b).get(u, 0) for u, v in weights(a).items()) for b in words] for a in words]
    assert np.allclose(got, want, rtol=1e-4)


def test_held_out_accuracy_with_gaps(machine):
    texts, toxic = made(200, 2)
    found = {i for i, _, _ in T.judge(machine, pa.array(texts, pa.large_string()))}
    assert sum(i in found for i, t in enumerate(toxic) if t) >= 45 and sum(i in found for i, t in enumerate(toxic) if not t) <= 6
    hidden = ["ri m o r o n ko.", "ri mo-ron ko.", "ri mor.on ko.", "ri idxiot ko.", "stuupid", "STUPID!"]
    assert {i for i, _, _ in T.judge(machine, pa.array(hidden, pa.large_string()))} == set(range(len(hidden)))


def test_bound_is_never_below_the_decision(machine):
    rng = random.Random(5)
    words = ["".join(rng.choices("moridtupacx1", k=rng.randint(1, 12))).encode() for _ in range(300)]
    chars = np.array([np.bitwise_or.reduce(T._CHAR_BIT[list(w)]) for w in words])
    assert (machine.at_most(chars) >= machine.decide(T.matrix(words)) - 1e-3).all()


def test_sentences_and_scores(machine):
    text = "ko ri. you moron ba! tel mun\nbari"
    [(row, score, sentences)] = T.judge(machine, pa.array([None, "", "?!", text], pa.large_string()).fill_null(""))
    assert row == 3 and score > 0 and sentences == ["you moron ba!"]


def test_long_text_is_judged_whole(machine):
    text = "ri ko. " * 60_000 + "x" * 5000 + " moron"
    assert [i for i, _, _ in T.judge(machine, pa.array([text, "ri ko. " * 60_000], pa.large_string()))] == [0]


def test_edges_in_spark(spark):
    texts, toxic = made(200, 1)
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(None, "you moron", None), (900, None, "b"), (901, "", "b"), (7, texts[4], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body string")
    labels = spark.createDataFrame(list(enumerate(toxic)) + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = T.toxic(docs, labels).collect()
    assert {None, 0, 4, 7} <= {r.doc_id for r in got} and not {900, 901} & {r.doc_id for r in got}
    none = spark.createDataFrame([], labels.schema)
    assert T.toxic(docs, none).count() == 0 and T.toxic(docs.limit(0), labels).count() == 0
    assert T.toxic(docs, labels.where("toxic = 0")).count() == 0


def plain_spans(text):
    """(first and last character, span) of a text of ASCII letters, digits, blanks and punctuation."""
    words = [(m.start(), m.end(), re.sub("[^a-z0-9]", "", m.group().lower())) for m in re.finditer(r"\S+", text)]
    words = [w for w in words if w[2]]
    out = list(words)
    for (a, _, x), (c, b, y) in zip(words, words[1:]):
        if not re.search(r"[.!?\n]", text[a:c]) and len(x) <= T.PART and len(y) <= T.PART and (len(x) > 1 or len(y) > 1):
            out.append((a, b, x + y))
    run = []
    for w in [*words, (0, 0, "")]:
        if len(w[2]) == 1:
            run.append(w)
            continue
        if len(run) >= 3:
            out.append((run[0][0], run[-1][1], "".join(r[2] for r in run)))
        run = []
    half = T.WINDOW // 2
    return [(a, b, w[i : i + T.WINDOW], " " in text[a:b] or "\n" in text[a:b]) for a, b, w in out for i in range(0, max(1, len(w) - half), half)]


def test_query_equals_judging_every_span_by_itself(spark):
    """Without bounds, caches and batches: each sentence's spans are cut in plain Python and compared with every landmark."""
    texts, toxic = made(300, 1)
    more, _ = made(60, 9)
    texts += more + ["You mo ron!\nko ri. s t u p i d, id iot?", "x" * 100 + "moron" + "y" * 60, "a b c. no"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    machine = T.fitted(docs, labels)
    got = {r.doc_id: (r.score, list(r.sentences)) for r in T.toxic(docs, labels).collect()}
    harmless = set(machine.harmless.tolist())
    want = {}
    for i, text in enumerate(texts):
        cuts = plain_spans(text)
        value = machine.decide(T.matrix([w.encode() for _, _, w, _ in cuts]))
        hashes = [int(T.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]) for _, _, w, _ in cuts]
        bad = [(a, b, v) for (a, b, w, joined), v, h in zip(cuts, value, hashes) if v > 0 and not (joined and len(text[a:b].split()) == 2 and h in harmless)]
        if bad:
            ends = sorted({(max((text.rfind(c, 0, a) for c in ".!?\n"), default=-1) + 1, min(x for x in [*(text.find(c, b - 1) for c in ".!?\n"), len(text)] if x >= 0)) for a, b, _ in bad})
            want[i] = (max(v for _, _, v in bad), [text[a : b + 1].strip().lower() for a, b in ends])
    assert set(got) == set(want) and len(want) > 60 and 360 in want and 362 not in want
    for i in want:
        assert abs(got[i][0] - want[i][0]) < 1e-4 and got[i][1] == want[i][1], (i, got[i], want[i])


def test_split_and_short_insults():
    rng = random.Random(4)
    texts, toxic = made(400, 1)
    texts = [t.replace("moron", "azz").replace("idiot", "azz") if y else t for t, y in zip(texts, toxic)]
    machine = T.train(texts, toxic)
    found = {i for i, _, _ in T.judge(machine, pa.array(["you azz ko", "mun stu pid", "ko ri mun", "a zz ri", rng.choice(texts[1:4])], pa.large_string()))}
    assert found == {0, 1, 3}


def test_landmarks_of_many_characters_take_no_memory():
    machine = T.Machine([b"abcdefghijklmnopqrstuvwx", b"moron"], np.array([1.0, 1.0]), -0.5)
    words = [b"abcdefghijklmnopqrstuvwx", b"moron", b"zzz", b"mxoron"]
    chars = np.array([np.bitwise_or.reduce(T._CHAR_BIT[list(w)]) for w in words])
    assert sum(share.nbytes for _, share in machine.bounds) < 1 << 18 and (machine.at_most(chars) >= machine.decide(T.matrix(words)) - 1e-3).all()
