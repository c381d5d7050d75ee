import base64
import hashlib
import json
import random
import string
import time

import pyarrow.parquet as pq
import pytest

from strandwise.llm.secret_scan import _BASE58, RULES, Scanner, crc_suffix, lowered, secrets

ALNUM = string.ascii_letters + string.digits


def github(rng, kind="ghp_", right=True):
    body = "".join(rng.choices(ALNUM, k=30))
    end = crc_suffix(body)
    return kind + body + (end if right else end[::-1] if end != end[::-1] else "zzzzzz")


def wallet(rng, right=True):
    raw = bytes.fromhex("0488ade4") + rng.randbytes(74)
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n = int.from_bytes(raw, "big") + (not right)
    out, digits = "", list(_BASE58)
    while n:
        n, d = divmod(n, 58)
        out = digits[d] + out
    return out


def everywhere(text):
    """Every pattern tried at every place of the text."""
    return {(r.name, m.start("s"), m.end("s"), r.checksum) for r in RULES for i in range(len(text)) if (m := r.pattern.match(text, i)) and r.valid(m.group("s"))}


def planted(rng):
    jwt = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": 1})) + ".sig"
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.b64encode(b"\x30" + rng.randbytes(90)).decode() + "\n-----END RSA PRIVATE KEY-----"
    return [github(rng), github(rng, "gho_"), github(rng, "npm_"), wallet(rng), jwt, pem, "AKIA" + "".join(rng.choices("ABCDEFGH234567", k=16)), f'token = "{rng.randbytes(20).hex()}"', f"API-KEY: '{rng.randbytes(12).hex()}'", "sk_live_" + "".join(rng.choices(ALNUM, k=24))]


def test_keywords_and_checksums_equal_all_patterns_everywhere():
    rng = random.Random(0)
    scanner, hits = Scanner(RULES), 0
    for _ in range(150):
        parts = rng.choices(planted(rng), k=3) + [github(rng, right=False), wallet(rng, right=False), "token is = 'no'", 'secret="aaaaaaaaaaaaaaaaaaaa"', "eyJx.y.z", "İ Token\n", "ghp_", "-----BEGIN PRIVATE KEY-----"]
        rng.shuffle(parts)
        text = "".join(p + rng.choice([" ", "\n", '"', "x", ", "]) for p in parts)
        want = everywhere(text)
        assert set(scanner.scan(text)) == want
        hits += len(want)
    assert hits > 250


def test_wrong_checksums_are_no_secrets():
    rng = random.Random(1)
    scanner = Scanner(RULES)
    for _ in range(20):
        assert [f[0] for f in scanner.scan("x " + github(rng) + " y")] == ["repository_token"] and not scanner.scan(github(rng, right=False))
        assert [f[0] for f in scanner.scan(wallet(rng))] == ["wallet_key"] and not scanner.scan(wallet(rng, right=False))
    assert len(lowered("aİB")) == 3


def test_tables(spark):
    rows = [(1, None), (2, ""), (None, 'the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###'), (3, "word " * 60_000 + 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!'), (4, "a token of thanks"), (4, "a token of thanks")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 id", "'b' body", "'r' rule")
    got = sorted((str(r.doc_id), r.rule, r.begin, r.secret) for r in secrets(docs).collect())
    assert got == [("3", "assigned", 300_009, "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"), ("None", "assigned", 13, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    assert secrets(docs.limit(0)).count() == 0 and secrets(docs, []).count() == 0


def test_documents_against_all_patterns_everywhere(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    want = {(d, *f[:3]) for d, t in pq.read_table(path, columns=["doc_id", "text"]).to_pandas().itertuples(index=False) for f in everywhere(t)}
    assert {(r.doc_id, r.rule, r.begin, r.end) for r in secrets(spark.read.parquet(path)).collect()} == want


def pem(kind, body, headers=""):
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{headers}{body}\n-----END {kind}PRIVATE KEY-----"


def test_planted_forms_of_assignments_and_keys():
    """The secrets are known from planting, not from RULES."""
    rng = random.Random(7)
    scanner = Scanner(RULES)
    b64 = lambda raw: base64.b64encode(raw).decode()
    openssh = pem("OPENSSH ", b64(b"openssh-key-v1\0" + rng.randbytes(120)))
    locked = pem("RSA ", b64(b"\x91" + rng.randbytes(95)), "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF\n\n")
    escaped = pem("", b64(b"\x30" + rng.randbytes(95))).replace("\n", "\\n")
    for key in (openssh, locked, escaped):
        assert [(r, a, b) for r, a, b, _ in scanner.scan(f"x {key} y")] == [("private_key", 2, 2 + len(key))]
    for before, secret, after in [
        ("PASSWORD=", "abc123def456", "\nUSER=x"),
        ("export DB_PASSWORD=", "Tr0ub4dor&3", ""),
        ("  password: ", "p@ss!w0rd#1", "\n"),
        ("password = '", "hunter2!", "'"),
        ('"password": "', "S3cr#t", '",'),
        ('SECRET_KEY = "', "django-insecure-8@x!k2", '"'),
        ("secretKey: '", "a1B2c3D4e5F6a7B8", "'"),
        ("API_KEY_2=", "9f8e7d6c5b4a39281706", ""),
        ("x?access_token=", "a81bc81bdead4e5d", "&page=2"),
        ("config['password'] = \"", "it's;9,fine", '"'),
        ("DB_PASS=", "q1w2e3r4t5", ";"),
        ('{\\"token\\": \\"', "a81bc81bdead4e5d", '\\"}'),
    ]:
        text = f"Zu {before}{secret}{after} end"
        assert [(r, text[a:b]) for r, a, b, _ in scanner.scan(text)] == [("assigned", secret)], text


def test_words_numbers_and_references_are_no_secrets():
    scanner = Scanner(RULES)
    for text in ["Password: required", "the secret: nobody", "max_tokens: 128000", "password = user_password", "password=${DB_PASSWORD1}", "token = get_token2('x')", "secret: <your-secret-1>", '"password": "Passwort"', "tokenizer_class: GPT2Tokenizer", "token_url: https://a.example/v1", "password=********", "secret: aaaaaaaa1", "token=$TOKEN_1", 'password: ""']:
        assert scanner.scan(text) == [], text
    assert scanner.scan(pem("", base64.b64encode(b"not a key at all, only text").decode())) == []


DEEP = base64.urlsafe_b64encode(b'{"a":' + b"[" * 200_000).decode()


@pytest.mark.parametrize(
    "part",
    ["eyJ", "eyJ.", "eyJhbGciOiJIUzI1NiJ9.", "xoxb-", "xoxb-1234567890", "token=", "token: ", "token='", 'password="', "secret=\\\"", "token=,", "token=a,", "password=a1b2c3.", "token_", "token_Aa", "Token", "pwd&a=", "pwd=&a", "-----BEGIN PRIVATE KEY-----", "-----BEGIN PRIVATE KEY", "-----", "ghp_", "xprv1", "AKIA", "sk_live_a", "api-key ", "token=x1]", "token=x1</", "ſecret=K"],
)
def test_a_megabyte_of_anything_is_scanned_in_seconds(part):
    for text in (part * (1_000_000 // len(part)), "token=" + part * (1_000_000 // len(part)), part + "," * 1_000_000, part + "x" * 1_000_000):
        began = time.time()
        Scanner(RULES).scan(text)
        assert time.time() - began < 5, (part, text[:40])


def test_nested_header_is_no_token():
    assert Scanner(RULES).scan("eyJ" + "hIjpb" + DEEP[8:] + ".x.y") == [] and Scanner(RULES).scan(DEEP[:1800] + ".x.y") == []


def test_values_end_at_the_next_assignment():
    text = "x password=abc123def token=f9e8d7c6b5;secret=q1w2e3r4t5,api_key=z9x8c7v6b5"
    assert [text[a:b] for _, a, b, _ in Scanner(RULES).scan(text)] == ["abc123def", "f9e8d7c6b5", "q1w2e3r4t5", "z9x8c7v6b5"]
