"""Exact deduplication by skew-safe combining.

Digests are counted first, eight bytes a row, and rows whose digest no other
row has pass through where they are. The others are combined in three steps:
within each map task, then in salted digest groups, then among the winners of
the salts. A group of any number of copies therefore never meets in one task:
the first step leaves a row a task, the second a row a salt. Every step groups
by digest and full text, so a collision of digests can't merge different texts.

Defined cases: null texts count as equal to each other, and so do empty ones.
Of equal texts the row with the smallest doc_id stays (a null doc_id last);
further ties, such as a repeated row, go to the row whose JSON is smallest.
Other columns, of any name, travel with their row. Texts of any length are
compared whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import materialize, small_side, table, whole_row

SALTS = 8


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each distinct text of ``docs``, with all its columns."""
    digest = F.xxhash64("text").alias("digest")
    again = materialize(docs.select(digest).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    known = small_side(again)
    rows = docs.select(digest, whole_row(docs).alias("row"))
    alone = rows.join(known, "digest", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*[F.col("row").getField(c).alias(c) for c in others])
    doc_id = F.col("row").getField("doc_id")
    several = rows.join(known, "digest", "left_semi").select(
        "digest",
        F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int").alias("salt"),
        F.col("row").getField("text").alias("body"),
        F.struct(doc_id.isNull().alias("last"), doc_id.alias("id"), F.to_json(rest).alias("tie")).alias("rank"),
        rest.alias("rest"),
    )
    best = F.min_by("rest", "rank").alias("rest"), F.min("rank").alias("rank")
    salted = several.groupBy("digest", "salt", "body").agg(*best)
    kept = salted.groupBy("digest", "body").agg(*best)
    return alone.unionAll(kept.select(*[F.col("body").alias(c) if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay."""
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source")


ORACLE = """
SELECT doc_id, lang, source FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, source, lang) = 1
"""
