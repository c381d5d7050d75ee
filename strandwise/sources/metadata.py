"""Metadata dumps: tar archives of XML files and the tab-separated table of accessions."""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.text import parse_date
from strandwise.sources.files import file_names, open_stream

TSV_COLUMNS = ["Accession", "Status", "Updated", "Published", "Type", "Visibility", "Received", "Center", "Experiment", "Sample", "Study", "Spots", "Bases"]
HIDDEN = ["suppressed", "controlled_access", "unpublished"]


def tar_members(spark: SparkSession, *paths: str) -> DataFrame:
    """(archive, member, text) of the files in tar and tar.gz archives, which are read as streams, a member at a time."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                with open_stream(path) as raw, tarfile.open(fileobj=raw, mode="r|*") as archive:
                    for entry in archive:
                        if entry.isfile():
                            text = archive.extractfile(entry).read().decode("utf-8", "replace").replace("\r", "")
                            yield pd.DataFrame([(path, entry.name, text)], columns=["archive", "member", "text"])

    return file_names(spark, *paths).mapInPandas(members, "archive string, member string, text string")


def runs_from_tsv(spark: SparkSession, *paths: str) -> DataFrame:
    """Runs of accession tables with a header: visible runs only, "-" for what is missing.

    (run_accession, experiment_accession, sample_accession, study_accession,
    sample_attributes, number_of_spots, number_of_bases, date_received); the
    center goes to the attributes, and the sample "Multiplex" is none. Columns
    are found by their names in the header; a missing one is an error, and so
    is a line of more or fewer fields than the header.
    """
    lines = spark.read.text(list(paths)).where("value <> ''").select(F.regexp_replace("value", "\r$", "").alias("line"))
    head = lines.first()
    names = head[0].split("\t") if head else []
    missing = [c for c in TSV_COLUMNS if c not in names]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    fields = F.split("line", "\t", -1)
    n = len(names)
    whole = F.when(F.size(fields) == n, fields).otherwise(F.raise_error(F.concat(F.lit(f"a line has not {n} fields: "), F.substring("line", 1, 200))).cast("array<string>"))
    body = lines.where(F.col("line") != F.lit(head[0])).select(whole.alias("f"))
    rows = body.select(*[F.nullif(F.col("f")[names.index(c)], F.lit("-")).alias(c) for c in TSV_COLUMNS])
    seen = (F.col("Type") == "RUN") & ~F.coalesce(F.col("Status").isin(HIDDEN), F.lit(False)) & ~F.coalesce(F.col("Visibility").isin(HIDDEN[:2]), F.lit(False))
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long"))
    center = F.when(F.col("Center").isNotNull(), F.create_map(F.lit("Center"), F.col("Center"))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.where(seen).select(
        F.col("Accession").alias("run_accession"),
        F.col("Experiment").alias("experiment_accession"),
        F.when(F.col("Sample") != "Multiplex", F.col("Sample")).alias("sample_accession"),
        F.col("Study").alias("study_accession"),
        center.alias("sample_attributes"),
        number("Spots").alias("number_of_spots"),
        number("Bases").alias("number_of_bases"),
        parse_date(F.col("Received")).alias("date_received"),
    )


def elements(members: DataFrame, tag: str) -> DataFrame:
    """(accession, body) of every <tag accession="..."> ... </tag> in the texts of ``members``."""
    whole = F.explode(F.regexp_extract_all("text", F.lit(rf"(?s)(<{re.escape(tag)}\b[^>]*>.*?</{re.escape(tag)}>)"), F.lit(1))).alias("body")
    return members.select(whole).select(F.regexp_extract("body", r'^<[^>]*\baccession="([^"]*)"', 1).alias("accession"), "body")


def _inner(tag: str):
    return F.nullif(F.regexp_extract("body", f"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit(""))


def experiments(members: DataFrame) -> DataFrame:
    """Experiments with their library; ``valid`` is false for those of a restricted archive."""
    names = {"experiment_title": "TITLE", "experiment_design_description": "DESIGN_DESCRIPTION", "experiment_library_name": "LIBRARY_NAME", "experiment_library_strategy": "LIBRARY_STRATEGY", "experiment_library_source": "LIBRARY_SOURCE", "experiment_library_selection": "LIBRARY_SELECTION", "experiment_instrument_model": "INSTRUMENT_MODEL"}
    restricted = F.lower("body").rlike(r'<external_id[^>]*namespace="dbgap"')
    return elements(members, "EXPERIMENT").select(F.col("accession").alias("experiment_accession"), (~restricted).alias("valid"), *[_inner(t).alias(c) for c, t in names.items()])


def samples(members: DataFrame) -> DataFrame:
    """Samples with taxon and attributes (of a repeated tag the last); the attribute BioSampleModel is left out."""
    pairs = F.regexp_extract_all("body", F.lit(r"(?s)<SAMPLE_ATTRIBUTE>(.*?)</SAMPLE_ATTRIBUTE>"), F.lit(1))
    entry = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, "(?s)<TAG>(.*?)</TAG>", 1).alias("key"), F.regexp_extract(x, "(?s)<VALUE>(.*?)</VALUE>", 1).alias("value")))
    use = F.filter(entry, lambda e: (e["key"] != "") & (e["key"] != "BioSampleModel"))
    last = F.filter(use, lambda e, i: ~F.exists(F.slice(use, i + 2, F.size(use)), lambda later: later["key"] == e["key"]))
    return elements(members, "SAMPLE").select(F.col("accession").alias("sample_accession"), _inner("SCIENTIFIC_NAME").alias("sample_taxa"), F.map_from_entries(last).alias("sample_attributes"))


def studies(members: DataFrame) -> DataFrame:
    return elements(members, "STUDY").select(F.col("accession").alias("study_accession"), _inner("STUDY_TITLE").alias("study_title"), _inner("STUDY_ABSTRACT").alias("study_abstract"))


def accession_list(spark: SparkSession, *paths: str) -> DataFrame:
    """(run_accession) of text files with an accession a line, each once."""
    return spark.read.text(list(paths)).select(F.trim("value").alias("run_accession")).where("run_accession <> ''").distinct()
