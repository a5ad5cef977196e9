"""Joining saved reputation answers to addresses and file hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logsift.constants import SCAN_CATEGORIES

_IP_PAYLOAD = (
    "data struct<abuseConfidenceScore:int, countryCode:string, isp:string, domain:string, "
    "totalReports:int, lastReportedAt:string>"
)
_SCAN_PAYLOAD = f"last_analysis_stats struct<{', '.join(f'`{c}`:bigint' for c in SCAN_CATEGORIES)}>"


def _zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def _filled(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def ip_reputation(responses: DataFrame) -> DataFrame:
    """Flat reputation rows from saved address answers ``(ip, payload)``."""
    data = F.from_json("payload", _IP_PAYLOAD)["data"]
    return responses.select("ip", data.alias("d")).select(
        "ip",
        _zero(F.col("d.abuseConfidenceScore")).alias("abuse_confidence_score"),
        _filled(F.col("d.countryCode")).alias("country_code"),
        _filled(F.col("d.isp")).alias("isp"),
        _filled(F.col("d.domain")).alias("domain"),
        _zero(F.col("d.totalReports")).alias("total_reports"),
        _filled(F.col("d.lastReportedAt")).alias("last_reported_at"),
    )


def hash_reputation(responses: DataFrame) -> DataFrame:
    """Flat scan rows from saved file answers ``(hash, payload)``.

    The detection ratio is malicious over all eight categories, 0 if nothing was counted.
    """
    stats = F.from_json("payload", _SCAN_PAYLOAD)["last_analysis_stats"]
    counts = {c: F.coalesce(F.col("s").getField(c), F.lit(0).cast("bigint")) for c in SCAN_CATEGORIES}
    total = sum(counts.values(), F.lit(0).cast("bigint"))
    shown = [counts[c].alias(c) for c in SCAN_CATEGORIES[:4]]
    ratio = F.coalesce(F.try_divide(counts["malicious"].cast("double"), total.cast("double")), F.lit(0.0))
    return responses.select("hash", stats.alias("s")).select("hash", *shown, ratio.alias("detection_ratio"))


def lookup_ips(ips: DataFrame, reputation: DataFrame, column: str = "source_ip") -> DataFrame:
    """Reputation of each distinct non-empty address; an unknown one gets a neutral row."""
    wanted = ips.filter(F.col(column) != "").select(F.col(column).alias("ip")).distinct()
    return wanted.join(reputation, "ip", "left").withColumns(
        {c: _zero(F.col(c)) for c in ("abuse_confidence_score", "total_reports")}
    )


def lookup_hashes(hashes: DataFrame, reputation: DataFrame, column: str = "hash") -> DataFrame:
    """Scan result of each distinct hash; an unknown one counts zero."""
    wanted = hashes.filter(F.col(column) != "").select(F.col(column).alias("hash")).distinct()
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in SCAN_CATEGORIES[:4]}
    zero["detection_ratio"] = F.coalesce("detection_ratio", F.lit(0.0))
    return wanted.join(reputation, "hash", "left").withColumns(zero)
