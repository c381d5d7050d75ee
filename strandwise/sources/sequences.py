"""Sequence files (FASTA and FASTQ, plain or gzip) as DataFrames (source, seq_id, defline, seq)."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.text import has_extension
from strandwise.sources.files import file_names, open_stream

EXTENSIONS = {"fasta": (".fna", ".fasta", ".fa"), "fastq": (".fastq", ".fq")}
SCHEMA = "source string, seq_id long, defline string, seq string"


def file_kind(path: str) -> str | None:
    """"fasta", "fastq" or None, by the extension, whatever its case; a final .gz counts for nothing."""
    low = path.lower().removesuffix(".gz")
    return next((kind for kind, ends in EXTENSIONS.items() if low.endswith(ends)), None)


def kind_column(path):
    """``file_kind`` as a column."""
    found = F.lit(None).cast("string")
    for kind, ends in EXTENSIONS.items():
        found = F.when(has_extension(path, *ends, *[e + ".gz" for e in ends]), F.lit(kind)).otherwise(found)
    return found


def parse_fasta(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(defline, sequence) of the records; a line that holds ">" is a defline, and a record without sequence isn't reported."""
    name, parts = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if ">" in line:
            if name is not None and parts:
                yield name, "".join(parts)
            name, parts = line.lstrip("> "), []
        elif name is not None and (seq := "".join(line.split()).upper()):
            parts.append(seq)
    if name is not None and parts:
        yield name, "".join(parts)


def parse_fastq(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(defline, sequence) of records of four lines; an empty sequence or a short record ends the file."""
    rows = iter(lines)
    for head in rows:
        seq = "".join(next(rows, "").split()).upper()
        if not seq or next(rows, None) is None or next(rows, None) is None:
            return
        yield head.rstrip("\r\n").removeprefix("@"), seq


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """The records of all sequence files at the paths (files or folders, searched deeply); other files are passed over.

    A file is one task's work, since records have no fixed bounds in a gzip
    stream; it is read as a stream, so files may be of any size and hold any
    number of records.
    """
    files = file_names(spark, *paths).where(kind_column(F.col("path")).isNotNull())

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                with open_stream(path) as raw:
                    stream = gzip.open(raw) if path.lower().endswith(".gz") else raw
                    lines = io.TextIOWrapper(stream, encoding="utf-8", errors="replace")
                    parser = parse_fasta if file_kind(path) == "fasta" else parse_fastq
                    rows, size = [], 0
                    for at, (name, seq) in enumerate(parser(lines)):
                        rows.append((path, at, name, seq))
                        size += len(seq)
                        if len(rows) == 10_000 or size > 1 << 24:
                            yield pd.DataFrame(rows, columns=["source", "seq_id", "defline", "seq"])
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=["source", "seq_id", "defline", "seq"])

    return files.mapInPandas(parse, SCHEMA)


def fasta_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, defline, seq) of plain FASTA files by the text reader alone, which splits large files at the records.

    As for ``parse_fasta``, a line that holds ">" is a defline, wherever it
    stands; only a ">" that begins a line is where a file is split.
    """
    rows = spark.read.option("lineSep", "\n>").text(list(paths)).select(F.input_file_name().alias("source"), F.regexp_replace("value", "\r", "").alias("value"))
    # a piece begins with a defline, or with what stands before the first one of its file; other deflines may follow
    lines = F.split(F.concat(F.when(F.col("value").startswith(">"), F.lit("")).otherwise(F.lit(">")), F.col("value")), "\n")
    step = lambda parts, line: F.when(line.contains(">"), F.concat(parts, F.array(F.struct(F.regexp_replace(line, "^[> ]+", "").alias("defline"), F.lit("").alias("seq"))))).otherwise(F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.struct(F.element_at(parts, -1)["defline"].alias("defline"), F.concat(F.element_at(parts, -1)["seq"], F.upper(F.regexp_replace(line, r"\s", ""))).alias("seq")))))
    records = F.aggregate(lines, F.array().cast("array<struct<defline: string, seq: string>>"), step)
    return rows.select("source", F.explode(records).alias("r")).select("source", "r.defline", "r.seq").where("seq <> ''")


def read_stats(reads: DataFrame) -> DataFrame:
    """(accession, n_reads, n_bases) of the reads of every run."""
    return reads.groupBy("accession").agg(F.count("*").alias("n_reads"), F.sum(F.coalesce(F.length("seq"), F.lit(0)).cast("long")).alias("n_bases"))


def read_range(reads: DataFrame, part: int, of: int) -> DataFrame:
    """The ``part``-th of ``of`` contiguous ranges of read_index (from 1 on); what is left over goes to the last ones."""
    if not 0 <= part < of:
        raise ValueError("part must be from 0 to of - 1")
    n = reads.agg(F.max("read_index")).first()[0] or 0
    size, rest = divmod(n, of)
    begin = part * size + max(0, part - (of - rest))
    length = size + (part >= of - rest)
    return reads.where(F.col("read_index").between(begin + 1, begin + length))
