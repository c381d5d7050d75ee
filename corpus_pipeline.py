"""The corpus pipeline: documents in, packed training bins out.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns what it keeps, which is written as Parquet and read again as the docs
of the next one. All but the last return the columns of documents.

Defined cases are those of the stages: a document without characters is
rejected by the first one, ids and other columns may be null or repeated, rows
without a doc_id have no near copies, further columns travel with their row,
texts of any length are read whole, ties go to the smallest doc_id, and empty
tables give no bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandwise.llm import decontaminate, exact_dedup, packing, quality, simhash
from strandwise.llm.common import materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return simhash.near_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of what is left."""
    return packing.best_fit(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL can express neither the classifier nor SimHash and packing; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what one keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
