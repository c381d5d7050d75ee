"""Files as streams, for readers that go through them once."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def file_names(spark: SparkSession, *paths: str, pattern: str | None = None) -> DataFrame:
    """(path) of all files at the paths, searched deeply; nothing of them is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(list(paths)).select("path")
    # a task a file, or nearly
    return files.repartition(max(1, spark.sparkContext.defaultParallelism))


def open_stream(path: str):
    """A file of any file system that Arrow knows, opened for reading in order."""
    from pyarrow import fs

    at = urlparse(path)
    if at.scheme in ("", "file"):
        return open(unquote(at.path), "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)
