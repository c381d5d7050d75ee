"""Secret scan: Aho-Corasick keywords, anchored patterns at the hits, checksums inside the matches.

One automaton of all keywords runs over the lower-cased text. Where a keyword
begins, the patterns of its rules are matched anchored at that place, and
nowhere else. A match of a kind that carries a checksum is reported only if
the checksum is right; the others must pass the test of their kind (a decoded
header, enough different characters): of the kinds below three carry a
checksum of their own. Texts are scanned whole.

A value assigned to a secret's name may be quoted or not, as in .env files and
YAML, from SHORTEST characters on; it holds no white space. It must vary, and a
short or unquoted one must mix kinds of characters, so that words, numbers,
names and references to where the secret is kept are none. A value without
quotes ends where the next assignment begins.

The work for a text grows with its length only, whatever it holds: the header
of a signed token has at most LONGEST_HEADER characters, a chat token ends
where the next begins, and values without quotes don't overlap.

Defined cases: null and empty texts, and empty tables, hold nothing. A span is
reported once for each rule that matches it, for each row; of overlapping
spans of several rules or beginnings all are reported. Ids may be null, rows
may repeat, and further columns may have any name. Offsets count characters.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import slices, table

LEAST_ENTROPY = 2.5
SHORTEST = 6
LONGEST_HEADER = 2048

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = {c: i for i, c in enumerate("123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz")}


def crc_suffix(body: str) -> str:
    """The six base-62 digits of a body's CRC-32 that end access tokens of several hosting services."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out


def crc_token(value: str) -> bool:
    body = value.split("_", 1)[1]
    return crc_suffix(body[:-6]) == body[-6:]


def base58_check(value: str) -> bool:
    """Base-58 text whose last four bytes begin the double SHA-256 of the rest."""
    n = 0
    for c in value:
        n = n * 58 + _BASE58[c]
    raw = n.to_bytes(82, "big") if n < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def signed_header(value: str) -> bool:
    head = value.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):  # no JSON, no mapping, or nested without end
        return False


def key_body(value: str) -> bool:
    """DER, an OpenSSH key, or anything in base 64 under headers that call it encrypted; line ends may be escaped."""
    inner = value.split("-----")[2].replace("\\r", "").replace("\\n", "\n")
    encrypted = re.search(r"Proc-Type:\s*4,\s*ENCRYPTED", inner) is not None
    inner = re.sub(r"Proc-Type:\s*4,\s*ENCRYPTED|DEK-Info:\s*\S+", "", inner)
    try:
        raw = base64.b64decode("".join("".join(line.split()) for line in inner.split("\n") if ":" not in line), validate=True)
    except ValueError:
        return False
    return raw[:1] == b"\x30" or raw.startswith(b"openssh-key-v1\0") or encrypted and len(raw) > 0


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def varied(value: str) -> bool:
    return entropy(value) >= LEAST_ENTROPY


_REFERENCE = re.compile(r"[$%]?[{<(\[]|\$[A-Za-z_]|%[A-Za-z_]+%$|[A-Za-z_][\w.]*[(\[]|\*+$")


def _refers(value: str) -> bool:
    """The value names a place where the secret is, or is blanked out."""
    return _REFERENCE.match(value) is not None or "://" in value and "@" not in value


def quoted_value(value: str) -> bool:
    kinds = sum(re.search(k, value) is not None for k in ("[a-z]", ".[A-Z]", "[0-9]", r"[^A-Za-z0-9_.\s-]"))
    return varied(value) and (len(value) >= 16 or kinds >= 2) and not _refers(value)


def bare_value(value: str) -> bool:
    mixed = re.search("[A-Za-z]", value) and re.search(r"[^A-Za-z_.-]", value)
    return len(value) >= SHORTEST and bool(mixed) and varied(value) and not _refers(value)


_NAMES = ("token", "secret", "password", "passwd", "passphrase", "pwd", "_pass", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey")
# the name may go on by parts (SECRET_KEY, secretKey), unless they say that the value is none
_ASSIGNED = r"(?:(?i:token|secret|password|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|_pass(?![a-z])))(?!(?i:[_-]?(?:name|type|url|uri|path|file|count|limit|size|length|ttl|expir[a-z]*|endpoint)\b))(?:[_-][A-Za-z0-9]++|[A-Z][a-z]++){0,4}+[0-9]{0,3}+(?:\\?[\"'`])?\]?\s*(?:=>|:=|={1,3}|:)"

# where a value without quotes ends: before punctuation that nothing follows, a further parameter, a closing tag
_PARAMETER = r"&[\w.-]++="
_END = rf"(?:</|{_PARAMETER}|(?<![,;)\]}}.])[,;)\]}}.]++(?:[\s\"'`\\]|</|{_PARAMETER}|{_ASSIGNED}|\Z))"


class Rule(NamedTuple):
    name: str
    keywords: tuple[str, ...]  # lower case; each begins every match
    pattern: re.Pattern  # the secret is its group "s"
    valid: Callable[[str], bool]
    checksum: bool


RULES = [
    Rule("repository_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"(?P<s>gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"), crc_token, True),
    Rule("package_token", ("npm_",), re.compile(r"(?P<s>npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])"), crc_token, True),
    Rule("wallet_key", ("xprv",), re.compile(r"(?P<s>xprv[1-9A-HJ-NP-Za-km-z]{107})(?![1-9A-HJ-NP-Za-km-z])"), base58_check, True),
    Rule("signed_token", ("eyj",), re.compile(rf"(?P<s>eyJ[A-Za-z0-9_-]{{1,{LONGEST_HEADER}}}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+)"), signed_header, False),
    Rule("private_key", ("-----begin",), re.compile(r"(?P<s>-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----)[\s\S])*-----END [A-Z ]*PRIVATE KEY-----)"), key_body, False),
    Rule("cloud_key_id", ("akia", "asia"), re.compile(r"(?P<s>A[KS]IA[A-Z2-7]{16})(?![A-Za-z0-9])"), varied, False),
    Rule("map_key", ("aiza",), re.compile(r"(?P<s>AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z_-])"), varied, False),
    Rule("chat_token", ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), re.compile(r"(?P<s>xox[abprs]-(?:(?!xox[abprs]-)[0-9A-Za-z-]){10,}+)"), varied, False),
    Rule("payment_key", ("sk_live_", "rk_live_"), re.compile(r"(?P<s>[sr]k_live_[0-9A-Za-z]{24,})"), varied, False),
    Rule("assigned", _NAMES, re.compile(_ASSIGNED + rf"\s*(?P<q>\\?[\"'`])(?P<s>(?:(?!(?P=q))\S){{{SHORTEST},}})(?P=q)"), quoted_value, False),
    Rule("assigned", _NAMES, re.compile(_ASSIGNED + rf"[ \t]*+(?P<s>(?!{_END})[^\s\"'`\\=:>](?:(?!{_END})(?!{_ASSIGNED})[^\s\"'`\\])*+)"), bare_value, False),
]


def lowered(text: str) -> str:
    """The text in lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Scanner:
    def __init__(self, rules: list[Rule]):
        import ahocorasick

        by_word = defaultdict(list)
        for rule in rules:
            for word in rule.keywords:
                by_word[word].append(rule)
        self.automaton = ahocorasick.Automaton()
        for word, own in by_word.items():
            self.automaton.add_word(word, (len(word), own))
        if by_word:
            self.automaton.make_automaton()
        self.empty = not by_word

    def scan(self, text: str) -> list[tuple[str, int, int, bool]]:
        """(rule, start, end, has a right checksum) of every secret."""
        found = set()
        if self.empty or not text:
            return []
        for last, (size, rules) in self.automaton.iter(lowered(text)):
            for rule in rules:
                m = rule.pattern.match(text, last - size + 1)
                if m and rule.valid(m.group("s")):
                    found.add((rule.name, m.start("s"), m.end("s"), rule.checksum))
        return sorted(found, key=lambda f: (f[1], f[2], f[0]))


def secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, rule, begin, end, secret, checksum) of every secret in ``docs``."""
    chosen = None if rules is None else list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(RULES if chosen is None else chosen)
        for batch in batches:
            for cut, texts in slices(batch, "body"):
                rows = [(i, name, lo, hi, t[lo:hi], check) for i, t in enumerate(texts.to_pylist()) for name, lo, hi, check in scanner.scan(t)]
                if rows:
                    at, names, lo, hi, value, check = zip(*rows)
                    columns = [cut.column("id").take(pa.array(at)), pa.array(names), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(value), pa.array(check)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rule", "begin", "end", "secret", "checksum"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body"))
    return rows.mapInArrow(run, "doc_id long, rule string, begin int, end int, secret string, checksum boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents."""
    return secrets(table(spark, sf_dir, "documents"))
