"""The stored events table: one folder per batch, and a manifest that says which batches count.

A batch is written first and then entered in the manifest by one file, so a job lost in between leaves a folder nobody reads, and
repeating it never duplicates a source, while repeated rows inside a source are kept. A rebuild enters its batch
under the next generation; readers see the newest one, so the old events stay readable until the new ones are complete.
One writer at a time.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from logsift.constants import EVENT_TYPES, FIELD_ALIASES
from logsift.operators.normalize import Aliases, is_analyzable, is_unstructured, normalize, normalize_all, normalize_layouts
from logsift.plans.shapes import join_keyed
from logsift.session import materialize
from logsift.sources.tabular import csv_layouts

EVENTS_SCHEMA = ", ".join(f"{c} {t}" for c, t in EVENT_TYPES.items()) + ", source string, batch string"
MANIFEST_SCHEMA = "generation bigint, source string, batch string"
# Name prefixes and tables that are never raw sources.
SYSTEM_PREFIXES = ("_logsift_",)
SYSTEM_TABLES = ("events", "allowlisted_indicators")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one where nothing has been written yet."""
    try:
        spark.read.parquet(path).schema
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


class EventStore:
    """Events under ``{path}/events`` and the manifest under ``{path}/manifest``."""

    def __init__(self, spark: SparkSession, path: str, aliases: Aliases = FIELD_ALIASES) -> None:
        self.spark = spark
        self.events_path = f"{path}/events"
        self.manifest_path = f"{path}/manifest"
        self.aliases = aliases

    def _manifest(self) -> tuple[DataFrame, int]:
        """Rows of the newest generation, and its number; a rebuild without sources has one row without a name."""
        entries = _read(self.spark, self.manifest_path, MANIFEST_SCHEMA)
        newest = entries.agg(F.max("generation")).head()[0] or 0
        return entries.filter(F.col("generation") == newest), newest

    def events(self) -> DataFrame:
        """Rows of the batches that count; an unfinished write is not visible."""
        stored = _read(self.spark, self.events_path, EVENTS_SCHEMA)
        current = materialize(self._manifest()[0].select("source", "batch").distinct(), "current")
        return join_keyed(stored, current, ["source", "batch"], "left_semi", stored=True).drop("batch")

    def sources(self) -> DataFrame:
        """Names of merged sources."""
        return self._manifest()[0].filter("source is not null").select("source").distinct()

    def append(self, sources: Mapping[str, DataFrame], include_unstructured: bool = False) -> list[str]:
        """Normalize and add every source not merged before; returns the names added."""
        names = [n for n, df in sources.items() if include_unstructured or not is_unstructured(df)]
        asked = self.spark.createDataFrame([(n,) for n in names], "source string")
        free = {r["source"] for r in asked.join(self.sources(), "source", "left_anti").collect()}  # some of the caller's names
        new = {n: sources[n] for n in names if n in free}
        if new:
            self._commit(normalize_all(new, include_unstructured, self.aliases), self._manifest()[1] or 1, list(new))
        return list(new)

    def append_files(self, path: str, include_unstructured: bool = False) -> int:
        """Normalize and add every CSV file below ``path`` not merged before, each a source named by its path; returns how many.

        Files with one header line are read together, so the plan grows with the number of layouts, not of files.
        """
        layouts = csv_layouts(self.spark, path, self.sources())
        return self._add_layouts(layouts, self._manifest()[1] or 1, include_unstructured)

    def rebuild(self, sources: Mapping[str, DataFrame], include_unstructured: bool = False) -> None:
        """Start over from the given raw tables; the old events count until the new ones are written."""
        names = [n for n, df in sources.items() if include_unstructured or not is_unstructured(df)]
        self._commit(normalize_all(sources, include_unstructured, self.aliases), self._manifest()[1] + 1, names)

    def rebuild_files(self, path: str, include_unstructured: bool = False) -> int:
        """Start over from the CSV files below ``path``; returns how many."""
        return self._add_layouts(csv_layouts(self.spark, path, self.sources().limit(0)), self._manifest()[1] + 1, include_unstructured, always=True)

    def _add_layouts(self, layouts: list[tuple[list[str], DataFrame]], generation: int, include_unstructured: bool, always: bool = False) -> int:
        events = normalize_layouts([df for _, df in layouts], include_unstructured, self.aliases)
        if events is None:
            if always:
                self._enter(self.spark.createDataFrame([(generation, None, None)], MANIFEST_SCHEMA))
            return 0
        # Names as the rows have them; a file without rows is no source yet.
        batch = self._write(events)
        names = _read(self.spark, f"{self.events_path}/batch={batch}", EVENTS_SCHEMA).select("source").distinct()
        entries = materialize(names.select(F.lit(generation).cast("bigint").alias("generation"), "source", F.lit(batch).alias("batch")), "entries")
        self._enter(entries)
        return entries.count()

    def _commit(self, events: DataFrame, generation: int, names: list[str]) -> None:
        batch = self._write(events)
        self._enter(self.spark.createDataFrame([(generation, n, batch) for n in names] or [(generation, None, None)], MANIFEST_SCHEMA))

    def _write(self, events: DataFrame) -> str:
        """Write a batch nobody reads yet."""
        batch = f"b{uuid4().hex}"
        events.write.parquet(f"{self.events_path}/batch={batch}")
        return batch

    def _enter(self, entries: DataFrame) -> None:
        # One file, whose appearance makes the batch count: a few dozen bytes per source.
        entries.coalesce(1).write.mode("append").parquet(self.manifest_path)


def replace_events(df: DataFrame, path: str, aliases: Aliases = FIELD_ALIASES) -> tuple[dict[str, str | None], DataFrame]:
    """Normalize one source into ``path``, replacing it: the column mapping and the stored table."""
    normalized, mapping = normalize(df, aliases)
    normalized.write.mode("overwrite").parquet(path)
    return mapping, df.sparkSession.read.schema(normalized.schema).parquet(path)


def write_raw(df: DataFrame, path: str) -> DataFrame:
    """Create or replace a raw table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw_tables(spark: SparkSession) -> list[str]:
    """Tables and views a user loaded, sorted."""
    names = [t.name for t in spark.catalog.listTables()]
    return sorted(n for n in names if n not in SYSTEM_TABLES and not n.startswith(SYSTEM_PREFIXES))


def describe_tables(spark: SparkSession, names: list[str] | None = None, aliases: Aliases = FIELD_ALIASES) -> DataFrame:
    """Row count, column list and analyzability of raw tables: one row per table."""
    parts = [
        spark.table(f"`{name}`").agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(", ".join(spark.table(f"`{name}`").columns)).alias("columns"),
            F.lit(is_analyzable(spark.table(f"`{name}`").columns, aliases)).alias("analyzable"),
        )
        for name in (raw_tables(spark) if names is None else names)
    ]
    if not parts:
        return spark.createDataFrame([], "table_name string, row_count bigint, columns string, analyzable boolean")
    return reduce(DataFrame.unionByName, parts)
