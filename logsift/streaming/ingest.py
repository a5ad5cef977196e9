"""Appending new source files to the events table as a stream.

The stream's checkpoint is the set of files already merged, so each file is taken
exactly once and a re-run after a failure continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logsift.constants import FIELD_ALIASES
from logsift.operators.extract import FIELDS, by_format, extract, settled_formats
from logsift.operators.normalize import normalize
from logsift.sources.lines import line_columns


def _append(events: DataFrame, events_path: str, checkpoint_path: str) -> StreamingQuery:
    return (
        events.writeStream.format("parquet")
        .outputMode("append")
        .option("path", events_path)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def stream_table_files(
    spark: SparkSession,
    raw_path: str,
    raw_schema: str,
    events_path: str,
    checkpoint_path: str,
    file_format: str = "parquet",
    aliases: Mapping[str, Sequence[str]] = FIELD_ALIASES,
    **options: str,
) -> StreamingQuery:
    """Normalize every new raw file below ``raw_path`` into the events table, then stop."""
    raw = spark.readStream.format(file_format).schema(raw_schema).options(**options).load(raw_path)
    return _append(normalize(raw, aliases)[0], events_path, checkpoint_path)


def stream_text_files(
    spark: SparkSession, raw_path: str, text_format: str, events_path: str, checkpoint_path: str
) -> StreamingQuery:
    """Extract and normalize every new text file of a known format, then stop."""
    # A blank line is NULL, as in the batch reader.
    lines = spark.readStream.text(raw_path).select(F.nullif(F.col("value"), F.lit("")).alias("line"))
    return _append(normalize(extract(lines, text_format))[0], events_path, checkpoint_path)


def stream_detected_text(
    spark: SparkSession,
    raw_path: str,
    events_path: str,
    formats_path: str,
    checkpoint_path: str,
    include_unstructured: bool = False,
    aliases: Mapping[str, Sequence[str]] = FIELD_ALIASES,
) -> StreamingQuery:
    """Detect, extract and normalize every new text file below ``raw_path``, then stop.

    A file's format is fixed by its head in the batch that brings it, and stored before its events are. A batch that is repeated
    after a failure takes the stored formats and replaces its own events, so nothing is added twice.
    Files that stay raw are left out unless ``include_unstructured``. Read the events with :func:`streamed_events`.
    """
    lines = spark.readStream.option("recursiveFileLookup", "true").text(raw_path).select(*line_columns())

    def merge(batch: DataFrame, batch_id: int) -> None:
        # Line numbers come from the batch's own scan, which cuts its files alike each time.
        numbered = batch.withColumn("pos", F.monotonically_increasing_id())
        stored = f"{formats_path}/batch={batch_id}"
        try:
            formats = batch.sparkSession.read.parquet(stored)
        except AnalysisException:
            settled_formats(numbered).write.mode("overwrite").parquet(stored)
            formats = batch.sparkSession.read.parquet(stored)
        rows = by_format(numbered, formats, stored=True)
        kept = rows if include_unstructured else rows.filter("structured")
        events = normalize(kept.select(*FIELDS, "raw_message"), aliases)[0]
        events.write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")

    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()


def streamed_events(spark: SparkSession, events_path: str) -> DataFrame:
    """The events of all batches of :func:`stream_detected_text`."""
    return spark.read.parquet(events_path).drop("batch")
