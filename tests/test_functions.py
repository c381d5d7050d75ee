import itertools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.functions import accession, bloom, dna, text
from strandwise.functions.hashing import masked, murmur3, parse_hash_name, with_hashes

GOLDEN = {
    "ACG": [1224338246, 703322154, 102023001, 120670261, 499023032],
    "ACGT": [867212194, 428108344, 3102675737, 1461135632, 1398544533],
    "ACGTACGTACG": [1996286843, 2922073411, 4275196609, 1761788948, 437470358],
    "AACGTTGCAAGTC": [4045420595, 522924602, 2806665674, 1444646259, 1762927158],
    "A" * 31: [820605550, 3649872140, 1030610160, 608920413, 2892750979],
    "ACGT" * 7 + "ACG": [2138772131, 382868691, 495372459, 349964287, 3707954330],
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_murmur_goldens(spark):
    for word, want in GOLDEN.items():
        rows = np.frombuffer(word.encode(), np.uint8)[None]
        assert murmur3(rows, range(5))[0].tolist() == want
        df = spark.createDataFrame([(word, 1), (word, 2)], "kmer string, n int")
        assert [r.hashes for r in with_hashes(df.select(dna.encode(F.col("kmer")).alias("kmer")), "kmer", len(word), range(5)).collect()] == [want, want]
    assert murmur3(np.frombuffer(b"hello", np.uint8)[None], [0])[0, 0] == 613153351
    assert with_hashes(df.select(dna.encode(F.col("kmer")).alias("kmer")).limit(0), "kmer", 3, range(5)).count() == 0


def test_hash_to_bit_and_name(spark):
    assert one(spark, masked(F.lit(4294967295).cast("long"), 18)) == (1 << 18) - 1
    assert one(spark, parse_hash_name(F.lit(" Murmur32"))) == "murmur32" and one(spark, parse_hash_name(F.lit("md5"))) is None


def windows(seq, k):
    return [w for i in range(len(seq) - k + 1) if set(w := seq[i : i + k].upper()) <= set("ACGT")]


def test_windows(spark):
    rng = random.Random(1)
    seqs = ["ACGNACGT", "acgt", "ACGU", "", None, "AC", *["".join(rng.choices("ACGTNacgt-", k=rng.randint(0, 60))) for _ in range(40)]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id int, seq string")
    for r in rows.select("seq", dna.kmers(F.col("seq"), 3).alias("k"), dna.kmers_by_place(F.col("seq"), 3).alias("p")).collect():
        assert (r.k or []) == windows(r.seq or "", 3)
        if r.seq:
            assert [(i, w) for i, w in enumerate(r.p) if w] == [(i, r.seq[i : i + 3].upper()) for i in range(len(r.seq) - 2) if windows(r.seq[i : i + 3], 3)]


def test_strands_and_codes(spark):
    words = ["".join(w) for w in itertools.product("ACGT", repeat=4)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    w = F.col("w")
    rows = df.select("w", dna.canonical(w).alias("c"), dna.canonical(dna.reverse_complement(w)).alias("d"), dna.encode(w).alias("n"), dna.decode(dna.encode(w), 4).alias("back")).collect()
    assert all(r.c == r.d and r.back == r.w for r in rows)
    assert [r.w for r in sorted(rows, key=lambda r: r.n)] == sorted(words)
    assert one(spark, dna.canonical(F.lit("ACGT"))) == "ACGT" and one(spark, dna.encode(F.lit("T" * 31))) == 4**31 - 1


def test_bloom_params(spark):
    golden = {1: (18, 5), 1000: (18, 5), 50_000: (18, 4), 75_000: (18, 2), 80_000: (18, 2), 1_000_000: (22, 3), 10_000_000: (25, 2), 500_000_000: (31, 3), 1_235_000_000: (32, 2), 1_300_000_000: (32, 2), 0: (None, None), 1 << 40: (None, None)}
    df = spark.createDataFrame([(n,) for n in golden], "n_kmers long")
    got = {r.n_kmers: (r.log_2_filter_len, r.num_hash) for r in bloom.bloom_params(df).collect()}
    assert got == golden
    assert bloom.most_kmers() == 2147483648 and bloom.most_kmers(0.25, 8, 12) == 2048


def test_counting_filter_and_files(spark):
    want = {1000: 18, 100_000: 20, 1_000_000: 23, 100_000_000: 29, 1_000_000_000: 32, 10_000_000_000: 32, 0: 32}
    df = spark.createDataFrame([(n,) for n in want], "n long")
    assert {r.n: r.x for r in df.select("n", bloom.counting_filter_log_len(F.col("n")).alias("x")).collect()} == want
    files = {18: 2048, 28: 2048, 29: 1024, 30: 512, 31: 256, 32: 128}
    df = spark.createDataFrame([(n,) for n in files], "n int")
    assert {r.n: r.x for r in df.select("n", bloom.filters_per_file(F.col("n")).alias("x")).collect()} == files


def test_accessions(spark):
    golden = {"SRR000001": 202032000021, "DRR000347": 39792005557, "ERR1197571": 506099161142, "SRR10054704": 20203360875271, "srr000001": 202032000021, "AAA0": None, "SR1": None, "SRRX1": None, "SRR": None, "SRR12345678901": None, None: None}
    df = spark.createDataFrame([(a,) for a in golden], "a string")
    for r in df.select("a", accession.pack(F.col("a")).alias("p"), accession.unpack(accession.pack(F.col("a"))).alias("back")).collect():
        assert r.p == golden[r.a] and r.back == (r.a.upper() if r.p else None)
    assert one(spark, accession.unpack(accession.pack(F.lit("ZZZ9999999999")))) == "ZZZ9999999999"
    for path, want in {"/a/b/SRR1.sra": "SRR1", "SRR2/": "SRR2", "x/.hid.y": ".hid", "/": "", "a_b": "a"}.items():
        assert one(spark, accession.from_path(F.lit(path))) == want


def test_text(spark):
    assert str(one(spark, text.parse_date(F.lit("2010-03-24T03:10:22Z")))) == "2010-03-24" and one(spark, text.parse_date(F.lit("soon"))) is None
    assert one(spark, text.format_date(F.lit("2010-03-24").cast("date"))) == "2010-3-24"
    assert one(spark, text.split_line(F.lit("a|b||c\r\nd"), "|")) == ["a", "b", "", "c"] and one(spark, text.split_line(F.lit("\nx"), "|")) == []
    for s, want in {"12": 12, "0x1F": 31, "0X1f": 31, "x": None, "": None, "-1": None, "0xFFFFFFFFFFFFFFFF": 2**64 - 1, "0x10000000000000000": None, "18446744073709551615": 2**64 - 1, "18446744073709551616": None, "0x000000000000000000001f": 31, "1" * 40: None}.items():
        assert one(spark, text.parse_uint(F.lit(s))) == want
    assert one(spark, text.find_ignoring_case(F.lit("abCD"), F.lit("cd"))) == 2 and one(spark, text.find_ignoring_case(F.lit("ab"), F.lit("x"))) == -1
    assert one(spark, text.xml_text(F.lit("<A>x<A>y</A>"), "A")) == "x<A>y" and one(spark, text.xml_text(F.lit("<B>"), "A")) is None
    assert one(spark, text.xml_attribute(F.lit('<E accession="X1" b="">'), "accession")) == "X1"
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    assert math.isclose(one(spark, text.percent_found(F.lit(1), F.lit(3))), f32(100 * f32(1 / 3)), rel_tol=1e-6) and one(spark, text.percent_found(F.lit(0), F.lit(0))) == 0


@pytest.mark.parametrize("name", ["x.FASTA", "x.fa.gz", "x.fna", "x.fastq.gz", "x.txt", "x.gz"])
def test_file_kind(spark, name):
    from strandwise.sources.sequences import file_kind, kind_column

    assert one(spark, kind_column(F.lit(name))) == file_kind(name)
