"""Every operator over tables with nulls in any column, empty and long texts, repeated rows, clashing columns, and over empty tables."""

import random

import pytest

import corpus_pipeline
from strandwise.llm.queries import QUERIES

ALL = QUERIES | {"pipeline": corpus_pipeline.run}
CLASHING = [x.strip() for x in "'x' id, 'y' body, 1 key, 2 bin, 'd' digest, 3 n, true near, 'h' host, array(1) tokens, 4 row, 5 salt, 'k' kind, 6 score, map('a', 1) m".replace("map('a', 1) m", "map('a',1) m").split(', ')]
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
}


def odd_texts(rng):
    words = ["the", "ciónes", "moron", "8.8.4.4", "x@y.org", "token=", '"a1b2c3d4e5f6a7b8"', "eyJ", "ghp_", "DE89", "3704", "天安门", "\u00a0", "“q”", "—", "\u200b", "😀", "e\u0301", "İ", "ß"]
    short = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(25)]
    long = ["eyJ" * 100_000, "\n" * 200_000, "8.8.4." + "5" * 300_000, "xoxb-" * 40_000, "a " * 150_000, "漢" * 100_000, "Plain words of a common kind. " * 8000, "\x00\x01\x7f", "\r\n\t\x0b\x0c", "DE89" + "1" * 6000]
    return [None, "", " ", *short, *long]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rng = random.Random(5)
    texts = odd_texts(rng)
    some = lambda *v: rng.choice([None, *v])
    rows = {
        "documents": [(some(*range(30)), t, some("en", "de", ""), some("s", "s", "t", ""), some(0, -1, 9)) for t in texts for _ in range(2)] + [(7, "same row", "en", "s", 1)] * 40 + [(None, "same row", None, None, None)] * 40,
        "pages": [(some(1, 2, 3), some("http://a.b/c", "", "nonsense", "http://casino-win.example.com/de/", "x" * 50_000), some(t, f"<p>{t}</p>", f"<nav><a href=x>{t}", "<" * 5000, "<div>" * 5000)) for t in texts],
        "benchmark": [(some(1, 2), t) for t in texts[:20]] + [(3, "same row"), (None, None)],
        "labels": [(some(*range(30)), some(0, 1), some(0, 1)) for _ in range(80)],
    }
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    for name, schema in SCHEMAS.items():
        frame = spark.createDataFrame(rows[name], schema).selectExpr("*", *CLASHING)
        frame.repartition(3).write.parquet(str(full / f"{name}.parquet"))
        frame.limit(0).write.parquet(str(empty / f"{name}.parquet"))
    return str(full), str(empty)


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_tables(spark, folders, name):
    full, empty = folders
    first = ALL[name](spark, full)
    rows = sorted(map(str, first.collect()))
    assert ALL[name](spark, empty).collect() == []
    if name in ("op6_exact_dedup", "op8_simhash", "op1_html_templates", "op2_quality"):
        assert rows
    if name not in ("op7_packing", "pipeline"):
        assert sorted(map(str, ALL[name](spark, full).collect())) == rows
