"""Choosing the reader for a file format or event-record tool."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from logsift.operators.extract import FIELDS, structured_lines
from logsift.operators.records import record_rows
from logsift.plans.shapes import fill_cores
from logsift.sources.lines import read_lines
from logsift.sources.tabular import read_csv, read_json

RECORD_SCHEMA = "event_record_id bigint, timestamp string, data string, _corrupt_record string"


def read_text_log(spark: SparkSession, path: str, max_lines: int = 0, structured: bool = True) -> DataFrame:
    """A text log: five text columns if any file yields fields, else a single ``line`` column."""
    parsed = structured_lines(read_lines(spark, path), max_lines, structured)
    if not structured or parsed.filter("structured").isEmpty():
        return parsed.select(F.col("raw_message").alias("line"))
    return parsed.select(*FIELDS, "raw_message")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Exported event records (JSON lines) as flat rows; a broken line fails the job like a broken record."""
    return record_rows(fill_cores(read_json(spark, path, RECORD_SCHEMA)))


def read_alerts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rule-engine alerts as CSV; the delimiter is taken from the header."""
    return read_csv(spark, path, sep=None)


Reader = Callable[[SparkSession, str], DataFrame]
READERS: Mapping[str, Reader] = {
    "csv": read_csv,
    "json": read_json,
    "evtx": read_records,
    "txt": read_text_log,
    "log": read_text_log,
}
RECORD_READERS: Mapping[str, Reader] = {
    "default": read_records,
    "alerts-csv": read_alerts_csv,
    "alerts-json": read_json,
}


def read_source(spark: SparkSession, path: str, file_format: str, tool: str | None = None) -> DataFrame:
    """Read ``path`` with the reader of its format, or of ``tool`` for event records."""
    if tool and file_format == "evtx":
        if tool not in RECORD_READERS:
            raise ValueError(f"Unknown record tool '{tool}'. Choices: {sorted(RECORD_READERS)}")
        return RECORD_READERS[tool](spark, path)
    if file_format not in READERS:
        raise ValueError(f"No reader for format '{file_format}'")
    return READERS[file_format](spark, path)
