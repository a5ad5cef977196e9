"""Raw event records together with the alerts of a rule engine."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from logsift.functions.text import sanitize_identifier
from logsift.operators.records import correlate_alerts
from logsift.session import materialize
from logsift.sources.adapters import RECORD_READERS, read_source

# Ways to load event records; ``hybrid`` reads the records and the alerts of a rule engine.
RECORD_TOOLS = (*RECORD_READERS, "hybrid")


@dataclass(frozen=True)
class HybridTables:
    raw: DataFrame
    alerts: DataFrame | None
    correlated: DataFrame | None
    # Why alerts or their correlation are missing.
    error: str | None = None


def correlation_view_name(base: str) -> str:
    return f"correlated_{sanitize_identifier(base)}"


def load_hybrid(base: str, raw: DataFrame | None, alerts: DataFrame | None = None) -> HybridTables:
    """Register ``{base}_raw``, ``{base}_alerts`` and their correlation as views.

    Raw events are required; they are flattened once and stored. Alerts are optional and stored as well:
    without them, if they cannot be read, or if they lack the columns to correlate, the load still succeeds and says why in ``error``.
    """
    if raw is None:
        raise ValueError("raw event records are required")
    name = sanitize_identifier(base)
    raw = materialize(raw, f"{name}_raw")
    raw.createOrReplaceTempView(f"{name}_raw")
    kept = correlated = None
    try:
        if alerts is not None:
            kept = materialize(alerts, f"{name}_alerts")
            kept.createOrReplaceTempView(f"{name}_alerts")
            correlated = materialize(correlate_alerts(kept, raw), f"{name}_correlated")
            correlated.createOrReplaceTempView(correlation_view_name(base))
    except (PySparkException, Py4JJavaError) as error:
        return HybridTables(raw, kept, None, str(error).partition("\n")[0])
    return HybridTables(raw, kept, correlated)


def ingest_records(spark: SparkSession, base: str, path: str, tool: str = "default", alerts_path: str | None = None, alerts_tool: str = "alerts-json") -> HybridTables:
    """Load event records by one of ``RECORD_TOOLS``; ``hybrid`` takes the alerts of ``alerts_path`` along, if they can be read."""
    if tool not in RECORD_TOOLS:
        raise ValueError(f"Unknown record tool '{tool}'. Choices: {sorted(RECORD_TOOLS)}")
    if tool != "hybrid":
        return load_hybrid(base, read_source(spark, path, "evtx", tool))
    raw = read_source(spark, path, "evtx")
    if alerts_path is None:
        return load_hybrid(base, raw)
    try:
        alerts = read_source(spark, alerts_path, "evtx", alerts_tool)
    except (PySparkException, Py4JJavaError) as error:
        tables = load_hybrid(base, raw)
        return HybridTables(tables.raw, None, None, str(error).partition("\n")[0])
    return load_hybrid(base, raw, alerts)


def has_correlation(spark: SparkSession, base: str) -> bool:
    return spark.catalog.tableExists(correlation_view_name(base))
