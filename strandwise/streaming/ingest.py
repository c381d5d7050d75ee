"""Incremental ingest: reads that arrive as files become filters, files of filters and states of runs.

The windows of every batch are counted and kept. A run whose reads come in
several batches gets its filter anew in each, from all of its counts so far, so
the index is the same however the files are dealt to batches. A batch that is
processed again (after a restart) gives the same tables: every batch writes its
own folder, and of a run the one of its last batch counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandwise.operators import index, kmers, packing
from strandwise.operators.common import small_side
from strandwise.operators.inventory import STATUS
from strandwise.session import discard, materialize

READS = "run_id long, seq string"
COUNTS = "id long, kmer long, n long, part int"
BLOCKS = "run_id long, kmer_len int, log_2_filter_len int, num_hash int, block long, bits binary"
PARAMS = "run_id long, kmer_len int, log_2_filter_len int, num_hash int, n_kmers long"
STATES = "run_id long, status int"
#: Folders of counts in a batch: a run that comes back is looked for in its own only.
PARTS = 64


def _known(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """What the batches before this one wrote."""
    try:
        return spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path).where(F.col("batch") < before).drop("batch")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def add_batch(reads: DataFrame, batch: int, root: str, k: int, min_count: int, shortest: int, longest: int) -> None:
    """Counts the windows of a batch and builds the filters of its runs under ``root``: counts, params, blocks and states, a folder a batch."""
    spark = reads.sparkSession
    at = f"batch={batch}"
    fresh = reads.select(F.col("run_id").alias("id"), "seq")
    # a row without a window stands for each sequence, so that runs without any are known too
    own = kmers.windows(fresh, k, with_length=True).groupBy("id", "kmer").agg(F.sum("n").alias("n"))
    own.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).write.mode("overwrite").partitionBy("part").parquet(f"{root}/counts/{at}")
    counts = spark.read.schema(COUNTS).parquet(f"{root}/counts/{at}")
    runs = materialize(counts.select("id", "part").distinct())
    back = runs.join(_known(spark, f"{root}/states", STATES, batch).select(F.col("run_id").alias("id")), "id", "left_semi")
    parts = [r[0] for r in back.select("part").distinct().collect()]
    if parts:
        earlier = _known(spark, f"{root}/counts", COUNTS, batch).where(F.col("part").isin(parts)).join(small_side(back.select("id")), "id", "left_semi")
        counts = counts.select("id", "kmer", "n").unionByName(earlier.select("id", "kmer", "n")).groupBy("id", "kmer").agg(F.sum("n").alias("n"))
    counted = materialize(counts.where(F.col("kmer").isNotNull() & (F.col("n") >= min_count)).select("id", "kmer"))
    index.run_params(counted, k, shortest, longest).write.mode("overwrite").parquet(f"{root}/params/{at}")
    params = spark.read.schema(PARAMS).parquet(f"{root}/params/{at}")
    index.merged(index.build(counted, params, k)).write.mode("overwrite").parquet(f"{root}/blocks/{at}")
    code = {s: i + 1 for i, s in enumerate(STATUS)}
    states = runs.select(F.col("id").alias("run_id")).join(params.select("run_id", F.lit(code["BLOOM_SUCCESS"]).alias("status")), "run_id", "left")
    # the states come last: a batch that broke off before is done anew
    states.select("run_id", F.coalesce("status", F.lit(code["BLOOM_INVALID"])).alias("status")).write.mode("overwrite").parquet(f"{root}/states/{at}")
    discard(runs, counted)


def ingest(spark: SparkSession, folder: str, root: str, k: int = 31, min_count: int = index.MIN_COUNT, shortest: int = 18, longest: int = 32, files_per_batch: int | None = None) -> StreamingQuery:
    """A stream over the Parquet files (run_id, seq) of ``folder`` that works off what is there and then ends.

    Started again with the same ``root``, it goes on with files that came since.
    """
    source = spark.readStream.schema(READS)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    writer = source.parquet(folder).writeStream.foreachBatch(lambda df, n: add_batch(df, n, root, k, min_count, shortest, longest))
    return writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def _latest(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Of every run the rows of the last batch that had reads of it."""
    read = lambda n, columns: spark.read.schema(f"{columns}, batch long").option("basePath", f"{root}/{n}").parquet(f"{root}/{n}")
    last = read("states", STATES).groupBy("run_id").agg(F.max("batch").alias("batch"))
    return read(name, schema).join(small_side(last), ["run_id", "batch"]).drop("batch")


def index_of(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, params) of all batches."""
    return _latest(spark, root, "blocks", BLOCKS), _latest(spark, root, "params", PARAMS)


def states_of(spark: SparkSession, root: str) -> DataFrame:
    return _latest(spark, root, "states", STATES)


def files_of(spark: SparkSession, root: str) -> DataFrame:
    """The packing of all filters so far into files."""
    return packing.packed(index_of(spark, root)[1])


#: What an event makes of a run's state.
EVENTS = {"download": "DOWNLOAD_SUCCESS", "bloom": "BLOOM_SUCCESS", "database": "DATABASE_SUCCESS"}


def final_states(events: DataFrame, most_failures: int = 3) -> DataFrame:
    """(run_id, state, failures) after all events (run_id, at, event) of a table, in the order of ``at``: what ``run_events`` says of them as a stream."""
    from pyspark.sql import Window

    before = Window.partitionBy("run_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    failed, ended = F.count_if(F.col("event") == "fail").over(before), F.count_if(F.col("event") == "database").over(before)
    # what comes after the end or the last failure changes nothing
    rows = events.select("run_id", "at", "event", failed.alias("failed"), ended.alias("ended")).where((F.col("failed") < most_failures) & (F.col("ended") == 0))
    known = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])
    says = F.when(F.col("event") == "fail", F.when(F.col("failed") + 1 >= most_failures, F.lit("FAILED")).otherwise(F.lit("INIT"))).otherwise(known[F.col("event")])
    out = rows.select("run_id", "at", "event", says.alias("says")).groupBy("run_id").agg(F.max_by("says", F.when(F.col("says").isNotNull(), F.col("at"))).alias("state"), F.count_if(F.col("event") == "fail").cast("int").alias("failures"))
    return out.select("run_id", F.coalesce("state", F.lit("INIT")).alias("state"), "failures")


def run_events(events: DataFrame, most_failures: int = 3) -> DataFrame:
    """State of each run over a stream of (run_id, event): "download", "bloom", "database" or "fail".

    A failed run is tried again until it has failed ``most_failures`` times;
    then it has failed for good, and later events change nothing.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, failures = state.get if state.exists else ("INIT", 0)
        for frame in frames:
            for event in frame["event"]:
                if name in ("FAILED", "DATABASE_SUCCESS"):
                    continue
                if event == "fail":
                    failures += 1
                    name = "FAILED" if failures >= most_failures else "INIT"
                else:
                    name = EVENTS.get(event, name)
        state.update((name, failures))
        yield pd.DataFrame({"run_id": [key[0]], "state": [name], "failures": [failures]})

    return events.groupBy("run_id").applyInPandasWithState(step, "run_id long, state string, failures int", "state string, failures int", "update", GroupStateTimeout.NoTimeout)
