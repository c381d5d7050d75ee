"""Packing of filters into files, and the plan of merging files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.bloom import filters_per_file


def packed(params: DataFrame) -> DataFrame:
    """``params`` (run_id, kmer_len, log_2_filter_len, num_hash) with file and place: full files in order of run_id for each set of parameters."""
    order = Window.partitionBy("kmer_len", "log_2_filter_len", "num_hash").orderBy("run_id")
    rank = F.row_number().over(order) - 1
    cap = filters_per_file(F.col("log_2_filter_len"))
    return params.withColumn("file", F.floor(rank / cap).cast("long")).withColumn("place", (rank % cap).cast("int"))


def merge_plan(files: list[tuple[str, int]], most: int) -> list[tuple[str, str, int, int]]:
    """(larger, smaller, filters in the larger afterwards, rest in the smaller) of each merge of the files (name, filters).

    The two smallest files are merged again and again; what doesn't fit in the
    larger stays in the smaller, which goes on as a file, and a full one is done.
    """
    todo, plan = sorted((n, name) for name, n in files), []
    while len(todo) > 1:
        (a, small), (b, large) = todo[:2]
        todo = todo[2:]
        into, rest = min(most, a + b), max(0, a + b - most)
        plan.append((large, small, into, rest))
        if rest:
            todo.append((rest, small))
        elif into < most:
            todo.append((into, large))
        todo.sort()
    return plan


def repacked(files: DataFrame, most: int) -> DataFrame:
    """(params, file, run_id) of filters (params, file, run_id) packed anew into as few files as possible, the largest files first and in their order."""
    keys = ["kmer_len", "log_2_filter_len", "num_hash"]
    sizes = files.groupBy(*keys, "file").agg(F.count("*").alias("size"))
    order = Window.partitionBy(*keys).orderBy(F.desc("size"), "file", "run_id")
    rows = files.join(sizes, [*keys, "file"]).withColumn("file", F.floor((F.row_number().over(order) - 1) / most).cast("long"))
    return rows.select(*keys, "file", "run_id")
