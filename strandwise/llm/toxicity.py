"""Toxicity by a subsequence string kernel with Nystroem landmarks and a support vector machine.

A span is the letters and digits of a word, lower-cased, of two neighbouring
words of a sentence of at most PART bytes ("mo ron"), or of a run of three or more words of
one character ("i d i o t"). Two spans are compared by the normalised
gap-weighted subsequence kernel: all common subsequences of ORDER characters,
each weighted DECAY to the power of the stretch it takes in either span, so
inserted characters cost little. Spans are mapped to Nystroem features of the
kernel at some landmarks, and a linear support vector machine on them decides.
The decision value of a sentence is the largest of its spans; it is toxic from
0 on, and so is a document with such a sentence.

The machine is trained on the sentences of at most TRAIN_DOCS labelled
documents (those with the smallest hash of doc_id) of at most TRAIN_CHARS
characters, as a multiple-instance problem: the label of a document says that
none of its sentences is toxic or that one at least is. Near copies count as
one document. At first the spans that stand for toxic sentences are those
whose share of toxic documents is beyond chance (likelihood ratio, corrected
for the number of spans), with variants of them with an inserted or doubled
character, and the negative ones are frequent spans of clean sentences. Then
every sentence of the sample is judged: the span by which a clean sentence
comes too near to the positive side joins the negative examples, the one that
gives a toxic document away joins the positive ones, and the machine is fitted
again. The bias is one of the best F1 on the labelled documents; pairs of
words that clean documents of the sample have can't make a sentence toxic.

A span whose set of characters already bounds its decision value below zero
(Cauchy-Schwarz on the subsequences it can share with each landmark) skips the
kernel; that changes no result. Decisions of distinct spans are kept by a
Python worker between batches. Spans longer than WINDOW bytes are cut into
windows that overlap by half.

Defined cases: null and empty texts, and ones without letters and digits, are
not toxic, and an empty table has no toxic rows. Without labels of both kinds,
or a span beyond chance, nothing is. Of a doc_id that is labelled both ways
toxic counts, and of several texts of a labelled doc_id the smallest. Spans of
fewer than ORDER letters have no kernel and are never toxic. Texts of any
length are judged whole. Rows are judged one by one, so repeated ones come back
as often; ids may be null and further columns have any name. Of sentences all
that are toxic are given, in the order of the text.
"""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import simhash
from strandwise.llm.common import NOT_SPACE, buffers, lower, mix, slices, small_side, span_hashes, spans, table, word_mask

TRAIN_DOCS = 4000
TRAIN_CHARS = 50_000  # longer labelled texts aren't in the sample
ORDER = 3
DECAY = 0.6
WINDOW = 24
PART = 5  # bytes of each of two neighbouring words up to which they are also seen as one
SIGNIFICANCE = 0.5  # words expected to be taken by mere chance
FIRST_NEGATIVES = 4000  # clean words of the first round; in the later ones every sentence of the sample is judged
POSITIVE_LANDMARKS, NEGATIVE_LANDMARKS = 32, 12
SPREAD = 256  # words among which the positive landmarks are chosen
ROUNDS = 2
MARGIN = -0.5  # decision value from which a span of a clean sentence counts as wrong
CACHE = 3_000_000
MOST_BITS = 14  # different characters of a landmark up to which the bound has a table

_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?\n")] = True
_CHAR_BIT = np.zeros(256, np.uint64)
for _b in range(256):
    # one bit a letter or digit, one for everything else
    _CHAR_BIT[_b] = 1 << (_b - 97 if 97 <= _b < 123 else 26 + _b - 48 if 48 <= _b < 58 else 36)


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernel values: n x m for s (n x L bytes) and t (m x T, or n x m x T for own ones); byte 0 pads and matches nothing."""
    t = t if t.ndim == 3 else t[None]
    n, (m, width) = len(s), t.shape[1:]
    reach = np.float32(DECAY) ** np.maximum(np.arange(width)[None, :] - np.arange(width)[:, None], 0).astype(np.float32)
    reach = np.triu(reach).astype(np.float32)
    square = np.float32(DECAY * DECAY)
    # partial[i][..., j]: weight of common subsequences of i + 1 characters that end in t[:j + 1], up to now
    partial = [np.zeros((n, m, width), np.float32) for _ in range(ORDER - 1)]
    total = np.zeros((n, m), np.float32)
    for x in s.T:
        same = ((t == x[:, None, None]) & (x != 0)[:, None, None]).astype(np.float32) * square
        total += (same[..., 1:] * partial[-1][..., :-1]).sum(axis=2)
        for i in reversed(range(ORDER - 1)):
            if i:
                new = np.zeros_like(same)
                new[..., 1:] = same[..., 1:] * partial[i - 1][..., :-1]
            else:
                new = same
            partial[i] *= np.float32(DECAY)
            partial[i] += new @ reach
    return total


def matrix(words: list[bytes]) -> np.ndarray:
    """Words as rows of bytes, padded by 0."""
    out = np.zeros((len(words), max(map(len, words), default=1)), np.uint8)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w, np.uint8)
    return out


def similarity(s: np.ndarray, t: np.ndarray, own_t: np.ndarray | None = None) -> np.ndarray:
    """Normalised kernel, 0 where a side has no subsequence of ORDER characters."""
    own_s = subsequence_kernel(s, s[:, None, :])[:, 0]
    own_t = subsequence_kernel(t, t[:, None, :])[:, 0] if own_t is None else own_t
    norm = np.sqrt(own_s[:, None] * own_t[None, :])
    return np.where(norm > 0, subsequence_kernel(s, t) / np.maximum(norm, 1e-30), 0)


def _chunks(n: int, size: int = 1024) -> Iterator[slice]:
    return (slice(i, i + size) for i in range(0, n, size))


@dataclass
class Machine:
    landmarks: list[bytes]
    weights: np.ndarray  # of the similarities to the landmarks
    bias: float
    harmless: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # hashes of pairs of words that clean documents have
    rows: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)
    bounds: list[tuple[list[int], np.ndarray]] = field(init=False)

    def __post_init__(self):
        self.rows = matrix(self.landmarks)
        self.own = subsequence_kernel(self.rows, self.rows[:, None, :])[:, 0]
        self.bounds = []
        for word, weight in zip(self.landmarks, self.weights):
            if weight <= 0:
                continue
            feature: Counter = Counter()
            for at in itertools.combinations(range(len(word)), ORDER):
                feature[tuple(word[i] for i in at)] += DECAY ** (at[-1] - at[0] + 1)
            bits = sorted({int(_CHAR_BIT[c]).bit_length() - 1 for c in word})
            if len(bits) > MOST_BITS:  # no table: the similarity is 1 at most
                self.bounds.append(([], np.array([weight])))
                continue
            place = {b: i for i, b in enumerate(bits)}
            share = np.zeros(1 << len(bits))
            for u, v in feature.items():
                need = 0
                for c in u:
                    need |= 1 << place[int(_CHAR_BIT[c]).bit_length() - 1]
                share[need] += v * v
            for i in range(len(bits)):  # sums over subsets
                share = share.reshape(-1, 2, 1 << i)
                share[:, 1] += share[:, 0]
                share = share.reshape(-1)
            self.bounds.append((bits, weight * np.sqrt(share / max(share[-1], 1e-30))))

    def decide(self, words: np.ndarray) -> np.ndarray:
        """Decision values of spans (rows of bytes)."""
        out = np.empty(len(words))
        for at in _chunks(len(words)):
            out[at] = similarity(words[at], self.rows, self.own) @ self.weights + self.bias
        return out

    def at_most(self, chars: np.ndarray) -> np.ndarray:
        """An upper bound of the decision value for each set of characters."""
        out = np.full(len(chars), self.bias + 1e-4)
        for bits, share in self.bounds:
            index = np.zeros(len(chars), np.int64)
            for i, b in enumerate(bits):
                index |= ((chars >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
            out += share[index]
        return out


@dataclass
class Spans:
    data: np.ndarray  # letters and digits of all texts
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    first: np.ndarray  # where the span lies in the texts' bytes
    last: np.ndarray
    pair: np.ndarray  # whether it is two words


def text_spans(texts: pa.Array, pairs: bool = True) -> Spans:
    """All spans of lower-cased texts, with or without those of two words."""
    raw, offsets = buffers(texts)
    begin, stop, rows = spans(raw, offsets, NOT_SPACE)
    keep = word_mask(raw)
    place = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    data = raw[keep]
    starts, ends = place[begin], place[stop]
    some = starts < ends
    begin, stop, rows, starts, ends = (x[some] for x in (begin, stop, rows, starts, ends))
    word_begin, word_stop, word_rows, first_byte, last_byte = begin, stop, rows, starts, ends
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    single = heads[ends] - heads[starts] == 1
    # runs of words of one character, on one row
    new = single.copy()
    new[1:] &= ~(single[:-1] & (rows[1:] == rows[:-1]))
    run_first = np.flatnonzero(new)
    goes_on = np.zeros(len(single), bool)
    goes_on[:-1] = single[1:] & (rows[1:] == rows[:-1])
    run_last = np.flatnonzero(single & ~goes_on)
    long = run_last - run_first >= 2
    run_first, run_last = run_first[long], run_last[long]
    begin, stop = np.append(begin, begin[run_first]), np.append(stop, stop[run_last])
    rows = np.append(rows, rows[run_first])
    starts, ends = np.append(starts, starts[run_first]), np.append(ends, ends[run_last])
    # neighbouring words on one row of which both are short, as one
    brief = (last_byte - first_byte) <= PART
    pair = np.flatnonzero(brief[:-1] & brief[1:] & (word_rows[1:] == word_rows[:-1]) & ~(single[:-1] & single[1:])) if pairs and len(brief) > 1 else np.zeros(0, np.int64)
    ends_sentence = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_BREAK[raw], out=ends_sentence[1:])
    pair = pair[ends_sentence[word_begin[pair]] == ends_sentence[word_begin[pair + 1]]]
    begin, stop = np.append(begin, word_begin[pair]), np.append(stop, word_stop[pair + 1])
    rows, starts, ends = np.append(rows, word_rows[pair]), np.append(starts, first_byte[pair]), np.append(ends, last_byte[pair + 1])
    is_pair = np.arange(len(starts)) >= len(starts) - len(pair)
    # windows of long spans
    half = WINDOW // 2
    parts = np.maximum(1, -(-(ends - starts - half) // half))
    of = np.repeat(np.arange(len(starts)), parts)
    step = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * half
    lo = starts[of] + step
    return Spans(data, lo, np.minimum(lo + WINDOW, ends[of]), rows[of], begin[of], stop[of], is_pair[of])


def _take(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spans as rows of bytes, padded by 0."""
    size = ends - starts
    at = np.arange(int(size.max(initial=1)))
    return np.where(at[None, :] < size[:, None], data[np.minimum(starts[:, None] + at[None, :], len(data) - 1)], 0).astype(np.uint8)


_kept: dict = {"machine": None, "keys": np.zeros(0, np.uint64), "values": np.zeros(0)}


def span_decisions(machine: Machine, s: Spans, floor: float = 0.0) -> np.ndarray:
    """Decision value of every span (or an upper bound of it that isn't above ``floor``)."""
    mark = (tuple(machine.landmarks), machine.weights.tobytes(), machine.bias, floor)  # pairs aside
    if _kept["machine"] != mark or len(_kept["keys"]) > CACHE:
        _kept.update(machine=mark, keys=np.zeros(0, np.uint64), values=np.zeros(0))
    if not len(s.starts):
        return np.zeros(0)
    hashes = span_hashes(s.data, s.starts, s.ends)
    keys, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    at = np.searchsorted(_kept["keys"], keys)
    known = at < len(_kept["keys"])
    known[known] = _kept["keys"][at[known]] == keys[known]
    values = np.empty(len(keys))
    values[known] = _kept["values"][at[known]]
    fresh = np.flatnonzero(~known)
    if len(fresh):
        starts, ends = s.starts[one[fresh]], s.ends[one[fresh]]
        bits = _CHAR_BIT[s.data]
        chars = np.zeros(len(fresh), np.uint64)
        size = ends - starts
        for k in range(int(size.max())):
            inside = size > k
            chars[inside] |= bits[starts[inside] + k]
        got = machine.at_most(chars)
        near = np.flatnonzero(got > floor)
        near = near[np.argsort(size[near], kind="stable")]
        for cut in _chunks(len(near)):
            i = near[cut]
            got[i] = machine.decide(_take(s.data, starts[i], ends[i]))
        values[fresh] = got
        _kept["keys"] = np.insert(_kept["keys"], at[fresh], keys[fresh])
        _kept["values"] = np.insert(_kept["values"], at[fresh], got)
    values = values[inverse]
    if len(machine.harmless) and s.pair.any():
        values[s.pair & np.isin(hashes, machine.harmless)] = -np.inf
    return values


def judge(machine: Machine, texts: pa.Array) -> Iterator[tuple[int, float, list[str]]]:
    """(row, score, toxic sentences) of the toxic texts."""
    low = lower(texts)
    s = text_spans(low)
    value = span_decisions(machine, s)
    hit = np.flatnonzero(value > 0)
    if not len(hit):
        return
    raw, offsets = buffers(low)
    breaks = np.flatnonzero(_BREAK[raw])
    for row in np.unique(s.rows[hit]):
        own = hit[s.rows[hit] == row]
        lo = np.searchsorted(breaks, s.first[own])
        hi = np.searchsorted(breaks, s.last[own] - 1)
        ends = sorted({(max(offsets[row], breaks[a - 1] + 1 if a else 0), min(offsets[row + 1], breaks[b] + 1 if b < len(breaks) else len(raw))) for a, b in zip(lo, hi)})
        yield int(row), float(value[own].max()), [raw[a:b].tobytes().decode(errors="replace").strip() for a, b in ends]


def _variants(word: bytes, rng: random.Random) -> list[bytes]:
    out = []
    for _ in range(6):
        at = rng.randint(1, len(word) - 1)
        out.append(word[:at] + rng.choice([bytes([rng.choice(b"aeioxz01")]), word[at - 1 : at]]) + word[at:])
    return out


def _text_cuts(texts: pa.Array, pairs: bool = False) -> Iterator[tuple[int, Spans]]:
    """(row of the first text, spans) of the texts, some at a time, to bound the memory."""
    at = 0
    for _, cut in slices(pa.record_batch([texts], names=["body"]), "body"):
        yield at, text_spans(cut, pairs)
        at += len(cut)


def evidence(texts: pa.Array, toxic: np.ndarray) -> tuple[dict[int, bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words by hash, the hashes sorted, documents that count for each, likelihood ratio of each: below 0 if toxic documents have it less often).

    A document counts for a word only if the word stands there between
    neighbours that no earlier document has around it: passages that documents
    share are one piece of evidence. Chance is the share of toxic documents
    among those of about the same length, as long ones hold more of all words.
    """
    known: dict[int, bytes] = {}
    hashes, rows = [], []
    for at, s in _text_cuts(texts):
        if not len(s.starts):
            continue
        order = np.lexsort((s.first, s.rows))
        own = span_hashes(s.data, s.starts, s.ends)[order]
        raw = s.data.tobytes()
        keys, one = np.unique(own, return_index=True)
        for key, i in zip(keys.tolist(), order[one].tolist()):
            if key not in known:
                known[key] = raw[s.starts[i] : s.ends[i]]
        hashes.append(own)
        rows.append(s.rows[order] + at)
    if not hashes:
        none = np.zeros(0)
        return {}, none.astype(np.uint64), none, none
    word, row = np.concatenate(hashes), np.concatenate(rows)
    size = np.bincount(row, minlength=len(texts))
    edge = row[1:] != row[:-1]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = np.where(edge, 0, word[:-1]), np.where(edge, 0, word[1:])
    context = mix(word + mix(before) * np.uint64(3) + mix(after) * np.uint64(5))
    _, one, inverse = np.unique(context, return_index=True, return_inverse=True)
    met = row[one][inverse] < row
    del context, before, after, inverse
    keys, word = np.unique(word, return_inverse=True)
    pairs, pair = np.unique(word * len(texts) + row, return_inverse=True)
    fresh = np.bincount(pair, met) == 0
    word, row = pairs[fresh] // len(texts), pairs[fresh] % len(texts)
    bucket = np.array([int(n).bit_length() for n in size])
    share_of = np.bincount(bucket, toxic) / np.maximum(np.bincount(bucket), 1)
    n, k = np.bincount(word, minlength=len(keys)), np.bincount(word, toxic[row], minlength=len(keys))
    e = np.bincount(word, share_of[bucket[row]], minlength=len(keys))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(k > 0, k * np.log(k / e), 0) + np.where(n > k, (n - k) * np.log((n - k) / (n - e)), 0))
    return known, keys, n, np.where(k > e, ratio, -ratio)


def _of_sentences(machine: Machine, texts: pa.Array, floor: float) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(document, decision values, spans): of every sentence the span of the highest decision value, if that is above ``floor``."""
    for at, s in _text_cuts(texts):
        if not len(s.starts):
            continue
        value = span_decisions(machine, s, floor)
        high = np.flatnonzero(value > floor)
        if not len(high):
            continue
        raw, _ = buffers(texts.slice(at, int(s.rows.max()) + 1))
        breaks = np.flatnonzero(_BREAK[raw])
        sentence = np.searchsorted(breaks, s.first[high]) * len(texts) + s.rows[high]
        order = np.lexsort((s.starts[high], -value[high], sentence))
        best = high[order[np.flatnonzero(np.diff(sentence[order], prepend=-1))]]
        data = s.data.tobytes()
        for row in np.unique(s.rows[best]):
            own = best[s.rows[best] == row]
            yield at + int(row), value[own], [data[s.starts[i] : s.ends[i]] for i in own]


def _separate(x: np.ndarray, y: np.ndarray, steps: int = 1500) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, both classes weighing the same."""
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    v = np.zeros(x.shape[1] + 1)
    z = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], 1e-4), 0)
    m, s = np.zeros_like(v), np.zeros_like(v)
    for step in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (z @ v))
        g = penalty * v - z.T @ (weight * slack * y)
        m = 0.9 * m + 0.1 * g
        s = 0.999 * s + 0.001 * g * g
        v -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-9)
    return v[:-1], float(v[-1])


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Machine | None:
    """The machine fitted on labelled documents; None if no word is beyond chance."""
    if len(set(toxic)) < 2:
        return None
    array = lower(pa.array(texts, pa.large_string()))
    # near copies are one document
    cuts, at = [], 0
    for _, cut in slices(pa.record_batch([array], names=["body"]), "body"):
        prints, rows = simhash.fingerprints(cut)
        cuts.append((prints, rows + at))
        at += len(cut)
    prints, at = (np.concatenate(x) for x in zip(*cuts))
    roots = np.arange(len(texts))
    roots[at] = at[simhash.bucket_groups(np.zeros(len(at), np.int64), prints)]
    first = [i for i in range(len(texts)) if roots[i] == i]
    labels = np.array([toxic[i] for i in first])
    if len(set(labels.tolist())) < 2:
        return None
    array = array.take(pa.array(first))
    known, keys, n, ratio = evidence(array, labels)
    size = np.array([len(known[key]) for key in keys.tolist()])
    # words expected to be beyond this by mere chance: SIGNIFICANCE
    least = 2 * math.log(max(len(keys), 2) / SIGNIFICANCE)
    beyond = np.flatnonzero((ratio >= least) & (size >= ORDER))
    plain = np.flatnonzero((ratio < 0) & (n > 0) & (size >= ORDER))
    if not len(beyond) or not len(plain):
        return None
    word = lambda at: [known[key] for key in keys[at].tolist()]
    positive = word(beyond[np.argsort(-ratio[beyond], kind="stable")])
    clean = word(plain[np.argsort(-n[plain], kind="stable")[:FIRST_NEGATIVES]])
    del known, keys, n, ratio, size
    landmarks = list(dict.fromkeys([*_spread(positive[:SPREAD], POSITIVE_LANDMARKS), *_nearest(clean, positive[:SPREAD], NEGATIVE_LANDMARKS)]))
    rows = matrix(landmarks)
    inner = similarity(rows, rows).astype(float)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T

    def features(words: list[bytes]) -> np.ndarray:
        return np.concatenate([similarity(matrix(words[c]), rows) for c in _chunks(len(words))]) @ root

    rng = random.Random(seed)
    examples = {w: -1.0 for w in clean} | {w: 1.0 for p in positive for w in (p, *_variants(p, rng))}
    x = features(list(examples))
    for turn in range(ROUNDS):
        v, bias = _separate(x, np.array(list(examples.values())))
        machine = Machine(landmarks, root @ v, bias)
        if turn == ROUNDS - 1:
            break
        # every sentence is judged: what is wrong in a clean one, and what gives a toxic document away, joins the examples
        fresh: dict[bytes, float] = {}
        for doc, values, words in _of_sentences(machine, array, MARGIN):
            if not labels[doc]:
                fresh |= {w: -1.0 for w in words if w not in examples}
            elif values.max() > 0 and (w := words[int(values.argmax())]) not in examples:
                fresh.setdefault(w, 1.0)
        if not fresh:
            break
        x = np.concatenate([x, features(list(fresh))])
        examples |= fresh
    return _calibrated(machine, array, labels)


def _nearest(words: list[bytes], to: list[bytes], most: int) -> list[bytes]:
    """Words spread evenly over the half that is more similar to others."""
    near = np.concatenate([similarity(matrix(words[c]), matrix(to)).max(axis=1) for c in _chunks(len(words), 256)])
    order = np.argsort(-near, kind="stable")[: max(1, len(words) // 2)]
    return [words[order[i]] for i in np.linspace(0, len(order) - 1, most).astype(int)]


def _spread(words: list[bytes], most: int) -> list[bytes]:
    """The first word and then always the one least similar to those chosen."""
    inner = similarity(matrix(words), matrix(words))
    chosen, nearest = [0], inner[0]
    while len(chosen) < min(most, len(words)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, inner[chosen[-1]])
    return [words[i] for i in chosen]


def _calibrated(machine: Machine, texts: pa.Array, labels: np.ndarray) -> Machine:
    """The machine with the bias that gives the labelled documents the best F1; it stays if it does, else it is set to the middle of the gap.

    Pairs of words that it would then find in clean documents are ruled out.
    """
    most = np.full(len(texts), -np.inf)
    pairs: dict[int, float] = {}
    for at, s in _text_cuts(texts, pairs=True):
        value = span_decisions(machine, s, MARGIN)
        np.maximum.at(most, s.rows[~s.pair] + at, value[~s.pair])
        own = np.flatnonzero(s.pair & (value > MARGIN))
        own = own[labels[s.rows[own] + at] == 0]
        pairs |= zip(span_hashes(s.data, s.starts[own], s.ends[own]).tolist(), value[own].tolist())
    most[most <= MARGIN] = -np.inf
    order = np.argsort(-most, kind="stable")
    most, hit = most[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(hit) + 1) + labels.sum())
    f1[:-1][most[:-1] == most[1:]] = 0
    f1[~np.isfinite(most)] = 0
    at = int(f1.argmax())
    if not np.isfinite(most[at]):
        return machine
    below = most[at + 1] if at + 1 < len(most) and np.isfinite(most[at + 1]) else MARGIN
    least = 0.0 if below < 0 < most[at] else (most[at] + below) / 2
    return Machine(machine.landmarks, machine.weights, machine.bias - least, np.array(sorted(k for k, v in pairs.items() if v > least), np.uint64))


def fitted(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Machine | None:
    """The machine for these tables."""
    chosen = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    rows = docs.where((F.col("text") != "") & (F.length("text") <= train_chars)).select("doc_id", F.col("text").alias("body")).join(small_side(chosen), "doc_id")
    # one text for each labelled id, so that the sample is bounded in rows and in characters
    rows = sorted(tuple(r) for r in rows.groupBy("doc_id", "toxic").agg(F.min("body").alias("body")).select("doc_id", "body", "toxic").collect())
    return train([r[1] for r in rows], [r[2] for r in rows]) if rows else None


def toxic(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, score, sentences) of the toxic documents."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, train_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                continue
            for cut, texts in slices(batch, "body"):
                rows = list(judge(shared.value, texts))
                if rows:
                    at, score, sentences = zip(*rows)
                    yield pa.RecordBatch.from_arrays([cut.column("id").take(pa.array(at)), pa.array(score), pa.array(sentences, pa.list_(pa.string()))], names=["doc_id", "score", "sentences"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body"))
    return rows.mapInArrow(run, "doc_id long, score double, sentences array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents."""
    return toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
