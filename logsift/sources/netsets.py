"""Threat-list files: one CIDR per line, ``#`` comments, an optional sidecar with fetch times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsift.sources.lines import plain_path


def list_name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.netset$", 1)


def parse_netset_lines(lines: DataFrame) -> DataFrame:
    """``(list_name, cidr)`` from ``(list_name, line)``: trimmed, without blanks and comments."""
    cidr = F.regexp_replace("line", r"^\s+|\s+$", "")
    return (
        lines.select("list_name", cidr.alias("cidr"))
        .filter((F.col("cidr") != "") & ~F.col("cidr").startswith("#"))
    )


def read_netsets(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.netset`` files of a folder as ``(list_name, cidr)``."""
    lines = spark.read.option("pathGlobFilter", "*.netset").text(folder)
    return parse_netset_lines(
        lines.select(list_name_of(plain_path()).alias("list_name"), F.col("value").alias("line"))
    )


def list_freshness(expected: DataFrame, files: DataFrame, now: Column, max_age_hours: int = 24) -> DataFrame:
    """``(list_name, loaded, stale)`` for every expected list.

    ``files`` has ``list_name, modified`` and, if known, ``fetched_at`` as ISO text. The
    fetch time counts where it parses, else the file time; a missing list is stale.
    """
    fetched = F.col("fetched_at").try_cast("timestamp")
    known = files.groupBy("list_name").agg(F.max(F.coalesce(fetched, F.col("modified"))).alias("as_of"))
    age = now.cast("timestamp").cast("double") - F.col("as_of").cast("timestamp").cast("double")
    return expected.select("list_name").distinct().join(known, "list_name", "left").select(
        "list_name",
        F.col("as_of").isNotNull().alias("loaded"),
        (F.col("as_of").isNull() | (age > max_age_hours * 3600)).alias("stale"),
    )


def read_list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(list_name, modified, fetched_at)`` of the lists in a folder and their ``.meta.json`` sidecars."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.netset").load(folder)
    lists = files.select(list_name_of(plain_path()).alias("list_name"), F.col("modificationTime").alias("modified"))
    sidecars = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta.json").load(folder)
    fetched = sidecars.select(
        F.regexp_extract(plain_path(), r"([^/]+)\.meta\.json$", 1).alias("list_name"),
        F.get_json_object(F.col("content").cast("string"), "$.fetched_at").alias("fetched_at"),
    )
    return lists.join(fetched, "list_name", "left")


def refresh_summary(log: DataFrame) -> DataFrame:
    """Refresh results ``(list_name, status)`` rolled up to updated / cached / error."""
    outcome = (
        F.when(F.col("status").isin("updated", "unchanged"), "updated")
        .when(F.col("status") == "cached", "cached")
        .when(F.col("status").startswith("error"), "error")
    )
    return (
        log.select("list_name", outcome.alias("outcome"))
        .filter(F.col("outcome").isNotNull())
        .groupBy("outcome")
        .agg(F.count(F.lit(1)).alias("n_results"), F.count_distinct("list_name").alias("n_lists"))
    )
