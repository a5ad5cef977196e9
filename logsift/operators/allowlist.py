"""The allowlist table and dropping allowlisted indicators.

Every change returns a new version of the table; writing it is left to the caller,
who never overwrites the path being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logsift.functions.address import canonical_address
from logsift.plans.shapes import join_keyed

ALLOWLIST_SCHEMA = (
    "id string, indicator string, indicator_type string, description string, metadata string, created_at timestamp_ntz"
)
KEY = ["indicator", "indicator_type"]


def with_defaults(entries: DataFrame, now: Column) -> DataFrame:
    return entries.withColumn("created_at", F.coalesce("created_at", now.cast("timestamp_ntz")))


def canonical_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with addresses in normal form, and the rejected ones whose address is invalid."""
    checked = entries.withColumn(
        "_address", F.when(F.col("indicator_type") == "ip", canonical_address(F.col("indicator")))
    )
    invalid = (F.col("indicator_type") == "ip") & F.col("_address").isNull()
    good = checked.filter(~F.coalesce(invalid, F.lit(False))).withColumn("indicator", F.coalesce("_address", "indicator"))
    return good.drop("_address"), checked.filter(invalid).drop("_address")


def insert(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` rows of an insert under the unique (indicator, type) key.

    Of several new rows with one key the smallest id is accepted, and one row of an id
    that occurs twice; everything else is rejected. Winners are found by aggregation
    and joined on the id, so a key with many copies stays spread out.
    """
    winners = new.groupBy(*KEY).agg(F.min("id").alias("id"))
    free = winners.join(existing.select(*KEY), KEY, "left_anti").select("id", *KEY)
    keys = ["id", *KEY]
    others = [c for c in new.columns if c not in keys]
    accepted = (
        new.join(free, keys, "left_semi")
        .groupBy(*keys)
        .agg(F.min(F.struct(*others)).alias("row"))
        .select(*keys, "row.*")
        .select(*new.columns)
    )
    return accepted, new.exceptAll(accepted)


def delete(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without the given ids; unknown ids change nothing."""
    return existing.join(ids.select("id"), "id", "left_anti")


def listing(entries: DataFrame, indicator_type: str | None = None) -> DataFrame:
    """Entries newest first, all or of one type."""
    scoped = entries if indicator_type is None else entries.filter(F.col("indicator_type") == indicator_type)
    return scoped.orderBy(F.desc("created_at"), F.asc("id"))


def membership(
    candidates: DataFrame, entries: DataFrame, column: str = "indicator", indicator_type: str | None = None
) -> DataFrame:
    """Candidates with a flag ``allowlisted``; repeated candidates are looked up once."""
    scoped = entries if indicator_type is None else entries.filter(F.col("indicator_type") == indicator_type)
    listed = scoped.select(F.col("indicator").alias(column)).distinct().withColumn("allowlisted", F.lit(True))
    known = candidates.select(column).distinct().join(listed, column, "inner")
    return join_keyed(candidates, known, [column]).withColumn(
        "allowlisted", F.coalesce("allowlisted", F.lit(False))
    )


def allowlisted_ips(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("indicator_type") == "ip").select(F.col("indicator").alias("match_ip")).distinct()


def drop_allowlisted(indicators: DataFrame, entries: DataFrame) -> DataFrame:
    """Indicators whose address is not allowlisted; those without an address stay."""
    return indicators.join(allowlisted_ips(entries), "match_ip", "left_anti").select(*indicators.columns)
