"""The run inventory: metadata joined from several tables, filtered, summed up and compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators.common import small_side

EXPERIMENT = ["experiment_title", "experiment_design_description", "experiment_library_name", "experiment_library_strategy", "experiment_library_source", "experiment_library_selection", "experiment_instrument_model"]
SCHEMA = (
    "run_accession string, experiment_accession string, "
    + ", ".join(f"{c} string" for c in EXPERIMENT)
    + ", sample_accession string, sample_taxa string, sample_attributes map<string,string>, study_accession string, study_title string, study_abstract string, number_of_spots long, number_of_bases long, date_received date"
)

STATUS = ["INIT", "DOWNLOAD_SUCCESS", "DOWNLOAD_FAIL", *[f"DOWNLOAD_FAIL_{i}" for i in range(1, 11)], "BLOOM_SUCCESS", "BLOOM_FAIL", "BLOOM_INVALID", "DATABASE_SUCCESS", "DATABASE_FAIL", "DATABASE_UPLOAD_FAIL", *[f"BLOOM_FAIL_{i}" for i in range(1, 11)], "SKIPPED"]


def _filled(name: str, other: str) -> Column:
    """The value of the other table unless it is null or empty."""
    return F.coalesce(F.nullif(F.col(other), F.lit("")), F.col(name)).alias(name)


def enriched(runs: DataFrame, experiments: DataFrame, samples: DataFrame, studies: DataFrame) -> DataFrame:
    """Runs with what the other tables know of their experiment, sample and study.

    Each join keeps runs without a partner. A value of the other table that
    isn't empty wins; sample attributes are united, and the sample's win.
    Runs of an experiment marked invalid (column ``valid``) go.
    """
    e = experiments.select("experiment_accession", "valid", *[F.col(c).alias(f"e_{c}") for c in EXPERIMENT])
    s = samples.select("sample_accession", F.col("sample_taxa").alias("s_taxa"), F.col("sample_attributes").alias("s_attributes"))
    t = studies.select("study_accession", F.col("study_title").alias("t_title"), F.col("study_abstract").alias("t_abstract"))
    rows = runs.join(e, "experiment_accession", "left").join(s, "sample_accession", "left").join(t, "study_accession", "left")
    empty = F.create_map().cast("map<string,string>")
    own, more = F.coalesce("sample_attributes", empty), F.coalesce("s_attributes", empty)
    united = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(more, k)), more)
    out = {c: _filled(c, f"e_{c}") for c in EXPERIMENT} | {"sample_taxa": _filled("sample_taxa", "s_taxa"), "study_title": _filled("study_title", "t_title"), "study_abstract": _filled("study_abstract", "t_abstract"), "sample_attributes": united.alias("sample_attributes")}
    return rows.where(F.coalesce("valid", F.lit(True))).select(*[out.get(c, F.col(c)) for c in runs.columns])


def chosen(runs: DataFrame, strategies: Sequence[str] = (), sources: Sequence[str] = (), begin: str = "0001-01-01", end: str = "9999-01-01") -> DataFrame:
    """Runs of one of the strategies and one of the sources (any, if none is given), received from ``begin`` to ``end``, both included."""
    if strategies:
        runs = runs.where(F.col("experiment_library_strategy").isin(list(strategies)))
    if sources:
        runs = runs.where(F.col("experiment_library_source").isin(list(sources)))
    return runs.where(F.col("date_received").between(F.lit(begin).cast("date"), F.lit(end).cast("date")))


def included(runs: DataFrame, accessions: DataFrame) -> DataFrame:
    """Runs on the list (run_accession)."""
    return runs.join(small_side(accessions.select("run_accession").distinct()), "run_accession", "left_semi")


def skipped(runs: DataFrame, accessions: DataFrame) -> DataFrame:
    """Runs that aren't on the list (run_accession)."""
    return runs.join(small_side(accessions.select("run_accession").distinct()), "run_accession", "left_anti")


def totals(runs: DataFrame) -> DataFrame:
    """One row: counts, sums, whole averages, the least non-zero and the largest run, in bases and spots."""
    bases, spots = F.col("number_of_bases"), F.col("number_of_spots")
    some = bases > 0
    first = lambda order: F.struct(order, F.col("run_accession"))
    return runs.agg(
        F.count("*").alias("n_runs"),
        F.sum(bases).alias("total_bases"),
        F.sum(spots).alias("total_spots"),
        F.expr("sum(number_of_bases) div nullif(count(*), 0)").alias("average_bases"),
        F.expr("sum(number_of_spots) div nullif(count(*), 0)").alias("average_spots"),
        F.min(F.when(some, bases)).alias("min_bases"),
        F.max(bases).alias("max_bases"),
        F.min_by("run_accession", F.when(some, first(bases))).alias("smallest_run"),
        F.min_by("run_accession", first(-bases)).alias("largest_run"),
        F.count_if(bases == 0).alias("n_empty"),
        (F.sum(bases) / F.lit(float(1 << 50))).alias("petabases"),
    )


def histogram(runs: DataFrame, bin_width: int = 1 << 30) -> DataFrame:
    """(bin, upper, n): runs by bases in bins of equal width, without empty ones.

    The range goes from the least non-zero number to the largest; the last bin
    is closed and also takes runs without bases. No bin if all are the same.
    """
    ends = runs.agg(F.min(F.when(F.col("number_of_bases") > 0, F.col("number_of_bases"))).alias("lo"), F.max("number_of_bases").alias("hi"))
    span = ends.select("lo", (F.col("hi") - F.col("lo")).alias("width")).where("width > 0").withColumn("bins", F.greatest(F.lit(1).cast("long"), F.expr(f"width div {int(bin_width)}")))
    rows = runs.select("number_of_bases").crossJoin(F.broadcast(span))
    place = F.floor(F.col("bins") * (F.col("number_of_bases") - F.col("lo")).cast("double") / F.col("width")).cast("long")
    at = F.when(F.col("number_of_bases") < F.col("lo"), F.col("bins") - 1).otherwise(F.least(place, F.col("bins") - 1))
    return rows.groupBy(at.alias("bin"), "bins", "width").agg(F.count("*").alias("n")).select("bin", F.expr("((bin + 1) * width) div bins").alias("upper"), "n")


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, run_accession) of accessions that only one inventory has: side 1 or 2."""
    a, b = left.select("run_accession"), right.select("run_accession")
    return a.subtract(b).select(F.lit(1).alias("side"), "run_accession").union(b.subtract(a).select(F.lit(2).alias("side"), "run_accession"))


def status_summary(status: DataFrame) -> DataFrame:
    """(status, name, n, percent) of the runs in each state (codes from 1 on)."""
    names = F.array(*[F.lit(s) for s in STATUS])
    counts = status.groupBy("status").agg(F.count("*").alias("n"))
    total = status.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("status", F.try_element_at(names, F.col("status").cast("int")).alias("name"), "n", (F.lit(100.0) * F.col("n") / F.col("total")).alias("percent"))


def retried(status: DataFrame) -> DataFrame:
    """``status`` with failed filters put back to the first state."""
    failed = F.col("status").isin([i + 1 for i, s in enumerate(STATUS) if s.startswith("BLOOM_FAIL")])
    return status.withColumn("status", F.when(failed, F.lit(1)).otherwise(F.col("status")).cast(status.schema["status"].dataType))


def marked(status: DataFrame, accessions: DataFrame, code: int) -> DataFrame:
    """``status`` (run_accession, status) with the listed runs set to ``code``; a listed run that isn't there is an error."""
    known = accessions.select("run_accession").distinct()
    missing = known.join(status, "run_accession", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"unknown run {missing[0][0]}")
    listed = known.withColumn("__listed", F.lit(True))
    kind = status.schema["status"].dataType
    return status.join(small_side(listed), "run_accession", "left").withColumn("status", F.when(F.col("__listed"), F.lit(code)).otherwise(F.col("status")).cast(kind)).select(*status.columns)


def shown(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns with NA for what is null or empty."""
    return rows.select(*[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("NA")).alias(c) for c in columns])


def attributes(rows: DataFrame) -> DataFrame:
    """(run_accession, tag, value) of the sample attributes."""
    return rows.select("run_accession", F.explode("sample_attributes").alias("tag", "value"))


def attribute_keys(rows: DataFrame) -> DataFrame:
    """(tag): the keys of all sample attributes, each once, in order."""
    return rows.select(F.explode(F.map_keys("sample_attributes")).alias("tag")).distinct().orderBy("tag")


def by_bases(runs: DataFrame) -> DataFrame:
    """The runs with the fewest bases first; of equal ones the smaller accession."""
    return runs.orderBy("number_of_bases", "run_accession")


def worst(status: DataFrame, part: str) -> DataFrame:
    """(part, status): the greatest code of every part, since any failure counts more than a success."""
    return status.groupBy(part).agg(F.max("status").alias("status"))


def pending(status: DataFrame, most: int) -> DataFrame:
    """The first ``most`` runs, by accession, that are still to be done."""
    return status.where(F.col("status") == 1).orderBy("run_accession").limit(most)


def write(runs: DataFrame, path: str) -> None:
    """Writes an inventory sorted by accession, so that a lookup reads the row groups it needs."""
    runs.repartitionByRange("run_accession").sortWithinPartitions("run_accession").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(stored: DataFrame, accessions: DataFrame) -> DataFrame:
    """The runs of a stored inventory with the accessions (run_accession) of a list."""
    return included(stored, accessions)
