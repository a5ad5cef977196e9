"""The six anomaly templates over the unified events schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from logsift.constants import BUCKET_WIDTH, ERROR_STATUS, NETWORK_EVENT, SEQUENCE_SEPARATOR
from logsift.plans.shapes import head_per_group
from logsift.session import materialize

# Up to this many result keys are sent to every task as a filter.
_MAX_BROADCAST_KEYS = 100_000
# Week-aligned origin of time buckets (Monday 2000-01-03), in epoch seconds.
_BUCKET_ORIGIN = 946_857_600


def _first(ordered: DataFrame, limit: int | None) -> DataFrame:
    return ordered if limit is None else ordered.limit(limit)


def top_talkers(events: DataFrame, min_events: int = 0, limit: int | None = 10) -> DataFrame:
    """Busiest addresses; ``limit=None`` returns them all."""
    return _first(
        events.filter(F.col("source_ip").isNotNull())
        .groupBy("source_ip")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .filter(F.col("event_count") >= min_events)
        .orderBy(F.desc("event_count"), F.asc("source_ip")),
        limit,
    )


def error_spikes(events: DataFrame, min_errors: int = 0, limit: int | None = 10) -> DataFrame:
    """Error responses per address and code, all with ``limit=None``; rows without an address form their own group."""
    return _first(
        events.filter(F.col("status_code") >= ERROR_STATUS)
        .groupBy("source_ip", "status_code")
        .agg(F.count(F.lit(1)).alias("error_count"))
        .filter(F.col("error_count") >= min_errors)
        .orderBy(F.desc("error_count"), F.asc_nulls_last("source_ip"), F.asc("status_code")),
        limit,
    )


def event_distribution(events: DataFrame, limit: int = 10) -> DataFrame:
    return (
        events.filter(F.col("event_type").isNotNull())
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .orderBy(F.desc("event_count"), F.asc("event_type"))
        .limit(limit)
    )


def bucket_start(seconds: Column, width_seconds: int) -> Column:
    """Epoch second at which the tumbling bucket holding ``seconds`` starts."""
    return F.floor((seconds - _BUCKET_ORIGIN) / width_seconds) * width_seconds + _BUCKET_ORIGIN


def width_in_seconds(width: str) -> int:
    amount, unit = width.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")]


def temporal_anomaly(events: DataFrame, min_events: int = 0, limit: int = 10, width: str = BUCKET_WIDTH) -> DataFrame:
    """Busiest time buckets; rows are grouped by a plain long, turned into a time at the end.

    Counting the key gives rows without a time a count of 0, which drops them without
    a filter that would parse the time a second time.
    """
    seconds = F.unix_seconds(F.col("event_timestamp").cast("timestamp"))
    return (
        events.select(bucket_start(seconds, width_in_seconds(width)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("bucket").alias("event_count"))
        .filter(F.col("event_count") >= max(min_events, 1))
        .select(F.timestamp_seconds("bucket").cast("timestamp_ntz").alias("time_bucket"), "event_count")
        .orderBy(F.desc("event_count"), F.asc("time_bucket"))
        .limit(limit)
    )


def connection_counts(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("event_type") == NETWORK_EVENT)
        .groupBy("process_name", "destination_ip")
        .agg(F.count(F.lit(1)).alias("connection_count"))
    )


def _is_rare(max_rare_count: int) -> Column:
    named = F.col("process_name").isNotNull() & F.col("destination_ip").isNotNull()
    return named & (F.col("connection_count") <= max(max_rare_count, 1))


def rare_pairs(events: DataFrame, max_rare_count: int = 2) -> DataFrame:
    """Rare process/destination pairs next to the total over all pairs, unnamed ones included.

    The pairs are counted once and written; the total is the sum of their counts, a scalar subquery.
    """
    counts = materialize(connection_counts(events), "pairs")
    total = counts.agg(F.coalesce(F.sum("connection_count"), F.lit(0)))
    return counts.filter(_is_rare(max_rare_count)).withColumn("total_connections", total.scalar())


def long_tail_analysis(events: DataFrame, max_rare_count: int = 2, limit: int = 50) -> DataFrame:
    """The rarest pairs next to the total, in one pass over the events.

    Pairs and total are two grouping sets of one aggregate; the total sorts before all pairs, so the rows of the report carry it.
    """
    keys = ["process_name", "destination_ip"]
    order = [F.asc("connection_count"), F.asc("process_name"), F.asc("destination_ip")]
    network = events.filter(F.col("event_type") == NETWORK_EVENT).select(*keys)
    counts = network.groupingSets([keys, []], *keys).agg(F.count(F.lit(1)).alias("connection_count"), (F.grouping_id() > 0).alias("_total"))
    top = counts.filter(F.col("_total") | _is_rare(max_rare_count)).orderBy(F.desc("_total"), *order).limit(limit + 1)
    # At most one row more than the report has.
    everything = Window.partitionBy(F.lit(1))
    total = F.max(F.when(F.col("_total"), F.col("connection_count"))).over(everything)
    return top.withColumn("total_connections", total).filter(~F.col("_total")).drop("_total").orderBy(*order)


def event_order() -> list[Column]:
    return [F.asc_nulls_last("event_timestamp"), F.asc_nulls_last("raw_message"), F.asc_nulls_last("event_type")]


def ranked_events(events: DataFrame, max_events_per_ip: int = 100) -> DataFrame:
    """The first events of every address, numbered in ``rn``."""
    usable = events.filter(F.col("source_ip").isNotNull() & F.col("event_type").isNotNull())
    usable = usable.select("source_ip", "event_type", "event_timestamp", "raw_message")
    return head_per_group(usable, ["source_ip"], event_order(), max_events_per_ip)


def source_ip_sequence(
    events: DataFrame, max_events_per_ip: int = 100, min_events: int = 1, limit: int = 20
) -> DataFrame:
    """The ordered event types of the busiest addresses, each cut to its first events.

    The reported count is the smaller of an address's event count and the cap, so
    the addresses that make the report are known from a plain count. Only their
    rows are ranked and concatenated.
    """
    usable = events.filter(F.col("source_ip").isNotNull() & F.col("event_type").isNotNull())
    winners = (
        usable.groupBy("source_ip")
        .agg(F.least(F.count(F.lit(1)), F.lit(max_events_per_ip)).alias("event_count"))
        .filter(F.col("event_count") >= max(min_events, 1))
        .orderBy(F.desc("event_count"), F.asc("source_ip"))
        .limit(limit)
        .select("source_ip")
    )
    if limit <= _MAX_BROADCAST_KEYS:
        winners = F.broadcast(winners)
    order = "event_timestamp nulls last, raw_message nulls last, event_type"
    return (
        ranked_events(usable.join(winners, "source_ip", "left_semi"), max_events_per_ip)
        .groupBy("source_ip")
        .agg(
            F.expr(f"listagg(event_type, '{SEQUENCE_SEPARATOR}') within group (order by {order})").alias(
                "event_sequence"
            ),
            F.count(F.lit(1)).alias("event_count"),
        )
        .orderBy(F.desc("event_count"), F.asc("source_ip"))
        .limit(limit)
    )


@dataclass(frozen=True)
class Template:
    """A named anomaly query and the parameters it runs with unless told otherwise."""

    name: str
    run: Callable[..., DataFrame]
    defaults: dict[str, int] = field(default_factory=dict)


TEMPLATES = {
    t.name: t
    for t in (
        Template("top_talkers", top_talkers, {"min_events": 0, "limit": 10}),
        Template("error_spikes", error_spikes, {"min_errors": 0, "limit": 10}),
        Template("event_distribution", event_distribution, {"limit": 10}),
        Template("temporal_anomaly", temporal_anomaly, {"min_events": 0, "limit": 10}),
        Template("long_tail_analysis", long_tail_analysis, {"max_rare_count": 2, "limit": 50}),
        Template("source_ip_sequence", source_ip_sequence, {"max_events_per_ip": 100, "min_events": 1, "limit": 20}),
    )
}


def run_templates(
    events: DataFrame,
    thresholds: Mapping[str, Mapping[str, int]] | None = None,
    names: Sequence[str] | None = None,
    templates: Mapping[str, Template] = TEMPLATES,
) -> dict[str, DataFrame]:
    """Chosen templates over one events table, with per-template parameter overrides."""
    results = {}
    for name, template in templates.items():
        if names is None or name in names:
            given = (thresholds or {}).get(name, {})
            results[name] = template.run(events, **{p: given.get(p, d) for p, d in template.defaults.items()})
    return results
