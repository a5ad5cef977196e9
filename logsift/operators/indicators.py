"""Turning template results into severity-scored indicators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logsift import constants as C
from logsift.functions.text import or_none, severity_checked

INDICATOR_COLUMNS = ("type", "severity", "description", "evidence", "match_ip", "source_ip", "threat_lists")
# Which evidence column an allowlist entry is compared with.
_MATCH_COLUMN = {
    "top_talkers": "source_ip",
    "error_spikes": "source_ip",
    "source_ip_sequence": "source_ip",
    "long_tail_analysis": "destination_ip",
}


@dataclass(frozen=True)
class SeverityThresholds:
    """Counts from which an indicator is Medium; twice that is High."""

    top_talkers: int = C.SEVERITY_THRESHOLDS["top_talkers"]
    error_spikes: int = C.SEVERITY_THRESHOLDS["error_spikes"]
    event_distribution: int = C.SEVERITY_THRESHOLDS["event_distribution"]
    temporal_anomaly: int = C.SEVERITY_THRESHOLDS["temporal_anomaly"]
    long_tail_analysis: int = C.SEVERITY_THRESHOLDS["long_tail_analysis"]
    source_ip_sequence: int = C.SEVERITY_THRESHOLDS["source_ip_sequence"]

    def with_overrides(self, overrides: Mapping[str, int] | None = None) -> dict[str, int]:
        return {**asdict(self), **(overrides or {})}


def severity(value: Column, threshold: int, indicator_type: str) -> Column:
    """Low / Medium / High; for rare pairs a single connection is the most severe."""
    if indicator_type == "long_tail_analysis":
        return F.when(value == 1, "High").otherwise("Medium")
    if threshold <= 0:
        return F.lit("Low")
    return F.when(value >= threshold * 2, "High").when(value >= threshold, "Medium").otherwise("Low")


def scored_value(df: DataFrame) -> Column:
    """First non-zero of the count columns the result has, else 0."""
    counts = [c for c in ("connection_count", "event_count", "error_count") if c in df.columns]
    return F.coalesce(*[F.nullif(F.col(c).cast("bigint"), F.lit(0).cast("bigint")) for c in counts], F.lit(0).cast("bigint"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else or_none(p) for p in parts])


def description(indicator_type: str, evidence: Column) -> Column:
    c = F.col
    if indicator_type == "top_talkers":
        return _text("IP ", c("source_ip"), " generated ", c("event_count"), " events")
    if indicator_type == "error_spikes":
        return _text("IP ", c("source_ip"), " returned HTTP ", c("status_code"), " ", c("error_count"), " times")
    if indicator_type == "event_distribution":
        return _text("Event type '", c("event_type"), "' occurred ", c("event_count"), " times")
    if indicator_type == "temporal_anomaly":
        return _text("Time bucket ", c("time_bucket"), " had ", c("event_count"), " events")
    if indicator_type == "long_tail_analysis":
        return _text(
            "Process '", c("process_name"), "' made ", c("connection_count"), " connection(s) to ",
            c("destination_ip"), " (of ", c("total_connections"), " total)",
        )
    if indicator_type == "source_ip_sequence":
        return _text("IP ", c("source_ip"), " had sequence: ", c("event_sequence"), " (", c("event_count"), " events)")
    return _text(f"Indicator of type {indicator_type}: ", evidence)


def evidence_json(df: DataFrame) -> Column:
    """The whole result row as JSON; times as text, NULLs kept."""
    fields = [
        (F.col(f.name).cast("string") if "timestamp" in f.dataType.typeName() else F.col(f.name)).alias(f.name)
        for f in df.schema.fields
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def to_indicators(df: DataFrame, indicator_type: str, threshold: int = 0) -> DataFrame:
    """Indicators of one template result."""
    def named(column: str | None) -> Column:
        return F.col(column) if column in df.columns else F.lit(None).cast("string")

    evidence = evidence_json(df)
    return df.select(
        F.lit(indicator_type).alias("type"),
        severity(scored_value(df), threshold, indicator_type).alias("severity"),
        description(indicator_type, evidence).alias("description"),
        evidence.alias("evidence"),
        named(_MATCH_COLUMN.get(indicator_type)).alias("match_ip"),
        named("source_ip").alias("source_ip"),
        F.array().cast("array<string>").alias("threat_lists"),
    )


def all_indicators(results: Mapping[str, DataFrame], thresholds: Mapping[str, int] | None = None) -> DataFrame:
    """Every template result as one flat set of indicators."""
    limits = SeverityThresholds().with_overrides(thresholds)
    parts = [to_indicators(df, name, limits.get(name, 0)) for name, df in results.items()]
    return reduce(DataFrame.unionByName, parts)


def check_severity(indicators: DataFrame) -> DataFrame:
    """Fails the job on a severity outside the known three."""
    return indicators.withColumn("severity", severity_checked(F.col("severity"), C.SEVERITIES))


def unique_source_ips(indicators: DataFrame) -> DataFrame:
    """Distinct, non-empty source addresses, in order."""
    return indicators.filter(F.col("source_ip") != "").select("source_ip").distinct().orderBy("source_ip")


def severity_counts(indicators: DataFrame) -> DataFrame:
    return indicators.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n_indicators"))


def report_table(indicators: DataFrame) -> DataFrame:
    """Display form: matched lists as text, ``-`` if there are none."""
    lists = F.when(F.size("threat_lists") > 0, F.array_join("threat_lists", ", ")).otherwise("-")
    return indicators.select("type", "severity", "description", "evidence", lists.alias("threat_lists"))
