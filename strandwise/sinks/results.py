"""Search results as CSV rows, JSON documents and per-read lines.

Results come as (query, num_kmers, num_kmers_found, run_accession, ...) with a
column ``info`` (a struct of the run's metadata) for JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.text import format_date, percent_found

CSV_COLUMNS = ["query", "num_kmers", "num_kmers_found", "percent_kmers_found", "sample_metadata"]


def query_label(source_rank: Column, number: Column, defline: Column) -> Column:
    """The label of a query: its defline, or its number for one given by hand (source_rank 0)."""
    return F.when(source_rank == 0, F.concat(F.lit("command line seq "), number.cast("string"))).otherwise(defline)


def csv_rows(results: DataFrame) -> DataFrame:
    """The columns of the CSV format; per cent in single precision."""
    percent = percent_found(F.col("num_kmers_found"), F.col("num_kmers"))
    return results.select("query", "num_kmers", "num_kmers_found", percent.alias("percent_kmers_found"), F.col("run_accession").alias("sample_metadata"))


def write_csv(results: DataFrame, path: str) -> None:
    csv_rows(results).sort("query", F.desc("num_kmers_found"), "sample_metadata").write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def info_json(info: str, fields: list[str]) -> Column:
    """A struct of run metadata as a map-like struct without empty fields; names have blanks for underscores, attributes are tag and value."""
    out = []
    for f in fields:
        column = F.col(f"{info}.{f}")
        if f == "sample_attributes":
            pairs = F.array_sort(F.map_entries(column))
            column = F.when(F.size(pairs) > 0, F.transform(pairs, lambda e: F.struct(e["key"].alias("tag"), e["value"].alias("value"))))
        elif f == "date_received":
            column = format_date(column)
        elif f in ("number_of_spots", "number_of_bases"):
            column = F.nullif(column, F.lit(0).cast("long"))
        else:
            column = F.nullif(column, F.lit(""))
        out.append(column.alias(f.replace("_", " ")))
    return F.struct(*out)


def json_documents(results: DataFrame, threshold: float, fields: list[str]) -> DataFrame:
    """(query, json): a document a query that has results, the best first. Strings are escaped; per cent has one decimal."""
    hit = F.struct(
        (-F.col("num_kmers_found")).alias("order"),
        F.col("run_accession").alias("tie"),
        F.struct(F.round(F.lit(100.0) * F.col("num_kmers_found") / F.greatest(F.col("num_kmers"), F.lit(1)), 1).alias("percent_kmers_found"), "num_kmers", "num_kmers_found", info_json("info", fields).alias("sample_metadata")).alias("hit"),
    )
    grouped = results.groupBy("query").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    document = F.struct("query", F.lit(threshold).alias("threshold"), F.transform("hits", lambda h: h["hit"]).alias("results"))
    return grouped.select("query", F.to_json(document).alias("json"))


def write_json(results: DataFrame, path: str, threshold: float, fields: list[str]) -> None:
    """A file of one JSON document a line."""
    json_documents(results, threshold, fields).sort("query").select("json").write.mode("overwrite").text(path)


def read_lines(hits: DataFrame) -> DataFrame:
    """(line): tab-separated accession, read number (with its part, if any), score, sequence and defline."""
    number = F.concat(F.col("read_index").cast("string"), F.when(F.col("read_subindex") > 0, F.concat(F.lit("."), F.col("read_subindex").cast("string"))).otherwise(F.lit("")))
    return hits.select(F.concat_ws("\t", "accession", number, F.col("score").cast("string"), "seq", "defline").alias("line"))
