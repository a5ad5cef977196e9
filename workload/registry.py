"""Registry of queries and, where SQL can express them, the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logsift.session import configure
from workload.relations import with_relations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, reads: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the derived relations named in ``reads``."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_relations(reads, sql)
        return fn

    return register
