from strandwise.llm.exact_dedup import exact_dedup


def test_cases(spark):
    rows = [(5, "same", "b", 1), (3, "same", "a", 2), (None, "same", "z", 3), (7, None, "a", 4), (6, None, "a", 5), (8, "", "a", 6), (9, "", "a", 7), (10, "x" * 200_000, "a", 8), (11, "x" * 200_000, "b", 9), (12, "x" * 199_999 + "y", "b", 9), (3, "same", "a", 2), (None, "only", None, None), (13, "Same", "c", 0), (14, "same ", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, salt int").repartition(5)
    kept = exact_dedup(docs)
    assert kept.dtypes == docs.dtypes
    got = {(r.doc_id, r.digest, r.salt) for r in kept.collect()}
    assert got == {(3, "a", 2), (6, "a", 5), (8, "a", 6), (10, "a", 8), (12, "b", 9), (None, None, None), (13, "c", 0), (14, "c", 0)}
    assert exact_dedup(docs.limit(0)).count() == 0


def test_result_does_not_depend_on_layout(spark):
    docs = spark.range(500).selectExpr("id doc_id", "cast(id % 37 as string) text", "array(id) body", "map('k', id) rest")
    for n in (1, 7):
        assert sorted(r.doc_id for r in exact_dedup(docs.repartition(n)).collect()) == list(range(37))
