"""Attack timeline: filters, headline metrics and ordered rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logsift import constants as C
from logsift.functions.text import duration_text, status_class, truncate_message
from logsift.operators.normalize import alias_view

ROW_COLUMNS = ("event_timestamp", "source_ip", "event_type", "status_code", "raw_message")


@dataclass(frozen=True)
class TimelineOptions:
    limit: int = C.TIMELINE_LIMIT
    source_ip: str | Sequence[str] | None = None
    min_status: int | None = None
    event_type: str | Sequence[str] | None = None


def _one_of(column: str, wanted: str | Sequence[str] | None) -> Column | None:
    if wanted is None:
        return None
    if isinstance(wanted, str):
        return F.col(column) == wanted
    return F.col(column).isin(*wanted) if len(wanted) else None


def filter_predicate(options: TimelineOptions) -> Column | None:
    """All given filters combined; an empty list filters nothing."""
    clauses = [
        _one_of("source_ip", options.source_ip),
        None if options.min_status is None else F.col("status_code") >= options.min_status,
        _one_of("event_type", options.event_type),
    ]
    given = [c for c in clauses if c is not None]
    return reduce(Column.__and__, given) if given else None


def apply_filters(events: DataFrame, options: TimelineOptions) -> DataFrame:
    predicate = filter_predicate(options)
    return events if predicate is None else events.filter(predicate)


def preset_options(label: str, **others: object) -> TimelineOptions:
    """Options for one of the status presets (``All``, ``>= 3xx``, ``>= 4xx``, ``>= 5xx``)."""
    return TimelineOptions(min_status=C.STATUS_PRESETS[label], **others)


def preset_counts(events: DataFrame) -> DataFrame:
    """``(preset, n)``: how many events each status preset keeps, from one pass over the events."""
    counts = {
        label: F.count(F.lit(1)) if low is None else F.count_if(F.col("status_code") >= low) for label, low in C.STATUS_PRESETS.items()}
    row = events.agg(F.array(*[F.struct(F.lit(label).alias("preset"), n.alias("n")) for label, n in counts.items()]).alias("all"))
    return row.select(F.inline("all"))


def metrics(events: DataFrame) -> DataFrame:
    """One row: totals, time span, distinct addresses, errors and error rate.

    Distinct addresses come from a second aggregate level over per-address partials
    instead of a distinct aggregate next to plain ones.
    """
    errors = F.count_if(F.col("status_code") >= C.ERROR_STATUS)
    per_address = events.groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_timestamp").alias("first_event"),
        F.max("event_timestamp").alias("last_event"),
        errors.alias("n_errors"),
    )
    totals = per_address.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.min("first_event").alias("first_event"),
        F.max("last_event").alias("last_event"),
        F.count("source_ip").alias("unique_source_ips"),
        F.coalesce(F.sum("n_errors"), F.lit(0)).alias("error_count"),
    )
    rate = F.round(F.lit(100.0).cast("double") * F.col("error_count") / F.col("total_events"), 1)
    return totals.select(
        "total_events",
        "first_event",
        "last_event",
        duration_text(F.col("first_event"), F.col("last_event")).alias("duration"),
        "unique_source_ips",
        "error_count",
        F.when(F.col("total_events") > 0, rate).otherwise(F.lit(0.0).cast("double")).alias("error_rate_pct"),
    )


def row_order(descending: bool = False) -> list[Column]:
    rest = ("raw_message", "source_ip", "event_type", "status_code")
    if descending:
        return [F.desc_nulls_first("event_timestamp"), *[F.desc_nulls_first(c) for c in rest]]
    return [F.asc_nulls_last("event_timestamp"), *[F.asc_nulls_last(c) for c in rest]]


def rows(events: DataFrame, limit: int = C.TIMELINE_LIMIT) -> DataFrame:
    """The earliest events in time order; unparsed times come last."""
    return events.select(*ROW_COLUMNS).orderBy(*row_order()).limit(limit)


def recent_rows(timeline_rows: DataFrame, n: int = C.RECENT_EVENTS) -> DataFrame:
    """The last rows of a timeline, newest first."""
    return timeline_rows.orderBy(*row_order(descending=True)).limit(n)


def build_timeline(raw: DataFrame, options: TimelineOptions | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics and rows of any analyzable table under one set of filters."""
    options = options or TimelineOptions()
    selected = apply_filters(alias_view(raw), options)
    return metrics(selected), rows(selected, options.limit)


def ip_frequencies(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("source_ip").isNotNull())
        .groupBy("source_ip")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), F.asc("source_ip"))
    )


def event_types(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isNotNull()).select("event_type").distinct().orderBy("event_type")


def filter_options(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a timeline can be filtered by: addresses with counts, and event types."""
    events = alias_view(raw)
    return ip_frequencies(events), event_types(events)


def points(timeline_rows: DataFrame) -> DataFrame:
    """Chart points of timeline rows, with display defaults and a status class."""
    return timeline_rows.select(
        "event_timestamp",
        F.coalesce(F.nullif("source_ip", F.lit("")), F.lit("unknown")).alias("source_ip"),
        F.coalesce(F.nullif("event_type", F.lit("")), F.lit("N/A")).alias("event_type"),
        "status_code",
        truncate_message(F.coalesce("raw_message", F.lit(""))).alias("message"),
        status_class(F.col("status_code")).alias("status_class"),
    )
