"""The query registry: name -> (spark, sf_dir) -> DataFrame, and its SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandwise.plans.base import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL."""

    def add(make: Callable[[Tables], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[make.__name__] = sql.strip()
        return make

    return add


from strandwise.plans import catalog  # noqa: E402, F401
