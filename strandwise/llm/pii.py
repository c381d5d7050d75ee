"""Personal data by a linear-chain conditional random field over word shapes.

Words are parted by white space, by quotes, commas and other separators, and
by the colon of a label ("mailto:"); punctuation at their ends is cut off. A
line is a sequence. A word is seen by its shape (capitals A, other letters a,
digits 9, runs once), the same without case, its number of digits, its length
and the signs in it, and by the shapes of the words before and after it.
Weights and transitions are fitted on a small labelled table (``pii_table``);
lines are decoded by Viterbi in numpy, thousands at a time. Card and account
numbers and phone numbers may be written in groups, as several words.

Spans that a checksum or range rules out are dropped: card numbers must pass
the Luhn test, an account number must be 1 modulo 97, an address must be one of
IPv4 (bytes up to 255, perhaps with a port, which isn't reported) or IPv6, a
security number must be one that is given out. If a span of several words fails
as a whole, its longest beginning of at most GROUPS words that passes is taken,
else its longest end.

Defined cases: null and empty texts, and empty tables, hold nothing. Spans are
reported for each row, so repeated rows come back as often; ids may be null and
further columns have any name. Offsets count characters. A word of any length
is one word, a line of any length is decoded as a whole, and no span crosses a
line. Of equally good readings the one with the smaller tags is taken.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import NOT_SPACE, buffers, runs, sign_mask, slices, span_hashes, table
from strandwise.llm.crf import fit, viterbi
from strandwise.llm.pii_table import SEPARATORS, TAGS, labelled_lines

#: Lines of the labelled table.
TRAIN_LINES = 1800
#: Most words of a card or account number.
GROUPS = 9

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = ord("9")
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("a")
_CLASS[128:] = ord("a")
_FOLDED = _CLASS.copy()
_FOLDED[65:91] = ord("a")
_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("+"), ord("("), ord(")")]] = True
_PART = NOT_SPACE.copy()
_PART[list(SEPARATORS.encode())] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NO_HEX = _ALNUM.copy()
_NO_HEX[[*range(48, 58), *range(65, 71), *range(97, 103)]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@dataclass
class Words:
    starts: np.ndarray  # of the words without punctuation at their ends, in bytes
    ends: np.ndarray
    rows: np.ndarray
    offsets: np.ndarray  # bounds of the lines
    features: np.ndarray  # words x templates: 64-bit hashes


def _counts(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=total[1:])
    return total[ends] - total[starts]


def _shapes(kinds: np.ndarray, fresh: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans with each run of one kind taken once."""
    new = fresh.copy()
    new[1:] |= kinds[1:] != kinds[:-1]
    place = np.zeros(len(kinds) + 1, np.int32)
    np.cumsum(new, out=place[1:])
    return span_hashes(kinds[new], place[starts], place[ends])


def _word_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    inside = _PART[data] & ~sign_mask(data)
    colon = np.flatnonzero(data == ord(":"))
    if len(colon):
        # a colon behind letters and digits that are no hexadecimal number ends a label
        alnum = _ALNUM[data]
        before = np.maximum.accumulate(np.where(alnum, -1, np.arange(len(data), dtype=np.int64)))
        row = offsets[np.searchsorted(offsets, colon, "right") - 1]
        begin = np.maximum(np.where(colon > 0, before[colon - 1], -1) + 1, row)
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_NO_HEX[data], out=total[1:])
        inside[colon[total[colon] > total[np.minimum(begin, colon)]]] = False
    return inside


def words(texts: pa.Array) -> Words:
    data, offsets = buffers(texts)
    starts, ends, rows = runs(_word_bytes(data, offsets), offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(1, np.int64), np.zeros((0, 7), np.uint64))
    whole_starts = starts
    core = _CORE[data]
    position = np.arange(len(data), dtype=np.int32)
    # the first core byte from each place on, and the last up to it
    later = np.minimum.accumulate(np.where(core, position, len(data))[::-1])[::-1]
    earlier = np.maximum.accumulate(np.where(core, position, -1))
    left, right = later[starts], earlier[ends - 1] + 1
    some = left < right
    starts, ends = np.where(some & (left < ends), left, starts), np.where(some & (left < ends), right, ends)
    fresh = np.zeros(len(data), bool)
    fresh[starts] = True
    shape, folded = _shapes(_CLASS[data], fresh, starts, ends), _shapes(_FOLDED[data], fresh, starts, ends)
    digits = np.minimum(_counts(_DIGIT[data], starts, ends), 40).astype(np.uint64)
    size = np.minimum(ends - starts, 40).astype(np.uint64)
    signs = np.zeros(len(starts), np.uint64)
    for sign, most in ((b"@", 2), (b".", 4), (b"-", 3), (b"+", 1), (b"(", 1), (b":", 4)):
        signs = signs * np.uint64(most + 1) + np.minimum(_counts(data == sign[0], starts, ends), most).astype(np.uint64)
    breaks = _counts(data == 10, np.zeros_like(whole_starts), whole_starts)
    first = np.ones(len(starts), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (breaks[1:] != breaks[:-1])
    before, after = np.zeros_like(folded), np.zeros_like(folded)
    before[1:], after[:-1] = np.where(first[1:], 0, folded[:-1]), np.where(first[1:], 0, folded[1:])
    features = np.column_stack([shape, folded, digits, size, signs, before, after])
    line_offsets = np.append(np.flatnonzero(first), len(starts))
    return Words(starts, ends, rows, line_offsets, features)


#: Templates whose values are small numbers; the others are hashes of shapes.
_SMALL = (2, 3, 4)
_SHAPE, _FOLD, _BEFORE, _AFTER = 0, 1, 5, 6


@dataclass
class Tagger:
    known: list[np.ndarray]  # sorted values of each template
    weights: list[np.ndarray]  # one row more than known: an unknown value weighs nothing
    transitions: np.ndarray

    def __post_init__(self):
        self.small = {c: self.weights[c][_number(np.arange(int(self.known[c].max()) + 2, dtype=np.uint64), self.known[c])] for c in _SMALL}
        # shapes without case serve three templates with one search
        self.folds = np.unique(np.concatenate([self.known[c] for c in (_FOLD, _BEFORE, _AFTER)]))
        wide = np.append(self.folds, np.uint64(0))
        self.fold = {c: self.weights[c][_number(wide, self.known[c])] for c in (_FOLD, _BEFORE, _AFTER)}
        for table_ in self.fold.values():
            table_[-1] = 0

    def tags(self, w: Words) -> np.ndarray:
        if not len(w.starts):
            return np.zeros(0, np.int64)
        columns = w.features.T
        unary = self.weights[_SHAPE][_number(columns[_SHAPE], self.known[_SHAPE])]
        for c, rows in self.small.items():
            unary += rows[np.minimum(columns[c], np.uint64(len(rows) - 1)).astype(np.int64)]
        fold = _number(columns[_FOLD], self.folds)
        edge = int(_number(np.zeros(1, np.uint64), self.folds)[0])
        first = np.zeros(len(fold) + 1, bool)
        first[w.offsets] = True
        before, after = np.full_like(fold, edge), np.full_like(fold, edge)
        before[1:], after[:-1] = np.where(first[1:-1], edge, fold[:-1]), np.where(first[1:-1], edge, fold[1:])
        for c, at in ((_FOLD, fold), (_BEFORE, before), (_AFTER, after)):
            unary += self.fold[c][at]
        return viterbi(unary, self.transitions, w.offsets)


def _number(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Position in ``known``, its length for an unknown value."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, len(known))


@cache
def tagger(lines: int = TRAIN_LINES) -> Tagger:
    """The field fitted on the labelled table."""
    rows = labelled_lines(lines)
    w = words(pa.array([text for text, _ in rows], pa.large_string()))
    states = np.array([TAGS.index(t) for _, tags in rows for t in tags])
    known = [np.unique(column) for column in w.features.T]
    base = np.concatenate([[0], np.cumsum([len(k) for k in known])])
    ids = np.column_stack([_number(c, k) + b for c, k, b in zip(w.features.T, known, base)])

    def pull(g: np.ndarray) -> np.ndarray:
        out = np.zeros((base[-1], len(TAGS)))
        for column in ids.T:
            np.add.at(out, column, g)
        return out

    weights, transitions = fit(lambda v: v[ids].sum(axis=1), pull, (int(base[-1]), len(TAGS)), states, w.offsets, steps=120, rate=0.15, l2=1e-4)
    parts = [np.vstack([weights[lo:hi], np.zeros((1, len(TAGS)))]).astype(np.float32) for lo, hi in zip(base, base[1:])]
    return Tagger(known, parts, transitions.astype(np.float32))


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isascii() and c.isdigit()][::-1]
    return bool(digits) and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


_FOUR = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})", re.A)
_PORT = re.compile(r"(?<=\d):\d{1,5}\Z", re.A)
_MAIL = re.compile(r"[^@\s]+@[^@\s]*[^@\s.]\.[^@\s.]+\Z")


def _is_card(text: str) -> bool:
    plain = text.replace(" ", "").replace("-", "")
    return 13 <= len(plain) <= 19 and plain.isascii() and plain.isdigit() and plain.strip("0") != "" and luhn(plain)


def _is_ip(text: str) -> bool:
    if m := _FOUR.fullmatch(text):
        return all(int(p) <= 255 for p in m.groups())
    try:
        return len(text) <= 45 and "%" not in text and ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


def _is_iban(text: str) -> bool:
    plain = text.replace(" ", "").replace("-", "").upper()
    if not (15 <= len(plain) <= 34 and plain.isascii() and plain.isalnum() and plain[:2].isalpha() and plain[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _is_ssn(text: str) -> bool:
    m = re.fullmatch(r"(\d{3})-(\d{2})-(\d{4})", text, re.A)
    return m is not None and m[1] not in ("000", "666") and m[2] != "00" and m[3] != "0000"


def _is_phone(text: str) -> bool:
    return len(text) <= 40 and 7 <= sum(c in "0123456789" for c in text) <= 15


_TEST = {"CARD": _is_card, "IP": _is_ip, "IBAN": _is_iban, "SSN": _is_ssn, "PHONE": _is_phone, "EMAIL": lambda t: _MAIL.match(t) is not None}


def plausible(kind: str, text: str) -> bool:
    """Whether a span passes the checksum or range of its kind."""
    return _TEST[kind](text)


def find(model: Tagger, texts: pa.Array) -> Iterator[tuple[int, str, int, int, str]]:
    """(row, kind, begin, end, text) of every span; begin and end count characters."""
    w = words(texts)
    tags = model.tags(w)
    hit = np.flatnonzero(tags)
    if not len(hit):
        return
    data, offsets = buffers(texts)
    heads = np.zeros(len(data) + 1, np.int64)  # characters before each byte
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    begins_line = np.zeros(len(tags) + 1, bool)
    begins_line[w.offsets] = True

    def value(first: int, last: int) -> str:
        return data[w.starts[first] : w.ends[last]].tobytes().decode(errors="replace")

    i = 0
    while i < len(hit):
        first = last = int(hit[i])
        kind = TAGS[tags[first]].split("_")[0]
        while not begins_line[last + 1] and TAGS[tags[last + 1]] == kind + "_I":
            last += 1
        while i < len(hit) and hit[i] <= last:
            i += 1
        # the whole span, then its beginnings and ends, the longest first
        most = min(GROUPS, last - first + 1)
        ways = [(first, first + n - 1) for n in range(most, 0, -1)] + [(last - n + 1, last) for n in range(most, 0, -1)]
        for a, b in ways:
            text = value(a, b)
            if kind == "IP" and not plausible(kind, text):
                text = _PORT.sub("", text)
            if plausible(kind, text):
                row = int(w.rows[a])
                begin = int(heads[w.starts[a]] - heads[offsets[row]])
                yield row, kind, begin, begin + len(text), text
                break


def personal_data(docs: DataFrame, train_lines: int = TRAIN_LINES) -> DataFrame:
    """(doc_id, kind, begin, end, value) of all personal data in ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger(train_lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, texts in slices(batch, "body"):
                rows = list(find(shared.value, texts))
                if rows:
                    at, kind, lo, hi, value = zip(*rows)
                    columns = [cut.column("id").take(pa.array(at)), pa.array(kind), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(value)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "kind", "begin", "end", "value"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body"))
    return rows.mapInArrow(run, "doc_id long, kind string, begin int, end int, value string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of all documents."""
    return personal_data(table(spark, sf_dir, "documents"))
