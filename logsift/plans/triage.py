"""The end-to-end triage job: events to scored, filtered and matched indicators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from logsift.constants import EVENT_COLUMNS
from logsift.operators.allowlist import allowlisted_ips, drop_allowlisted
from logsift.operators.indicators import all_indicators
from logsift.operators.netmatch import attach_lists
from logsift.operators.templates import run_templates
from logsift.plans.shapes import join_keyed
from logsift.session import is_stored, materialize


def triage(
    events: DataFrame,
    allowlist: DataFrame | None = None,
    netset: DataFrame | None = None,
    *,
    template_thresholds: Mapping[str, Mapping[str, int]] | None = None,
    severity_thresholds: Mapping[str, int] | None = None,
    template_names: Sequence[str] | None = None,
    allowlist_before_limit: bool = False,
    store_events: bool = True,
) -> DataFrame:
    """Run the templates, score their rows, drop allowlisted addresses, attach threat lists.

    Six templates read the events, so events that are computed rather than stored are
    written once first (``store_events``). By default the allowlist is applied after
    each template's limit: a dropped talker does not promote the next one.
    """
    events = events.select(*EVENT_COLUMNS)
    if store_events and not is_stored(events):
        events = materialize(events, "events")
    by_source = events
    if allowlist is not None and allowlist_before_limit:
        listed = allowlisted_ips(allowlist)
        by_source = join_keyed(events, listed.withColumnRenamed("match_ip", "source_ip"), ["source_ip"], "left_anti")
        by_target = join_keyed(
            events, listed.withColumnRenamed("match_ip", "destination_ip"), ["destination_ip"], "left_anti"
        )
        per_table = {
            "top_talkers": by_source, "error_spikes": by_source, "source_ip_sequence": by_source,
            "long_tail_analysis": by_target,
        }
        results = {}
        for name, result in run_templates(events, template_thresholds, template_names).items():
            table = per_table.get(name)
            results[name] = result if table is None else run_templates(table, template_thresholds, [name])[name]
    else:
        results = run_templates(events, template_thresholds, template_names)
    found = all_indicators(results, severity_thresholds)
    if allowlist is not None and not allowlist_before_limit:
        found = drop_allowlisted(found, allowlist)
    if netset is not None:
        found = attach_lists(materialize(found, "indicators"), netset)
    return found
