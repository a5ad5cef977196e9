"""Matching addresses against CIDR lists.

Networks lie inside each other or apart, so they cut the address space into disjoint ranges, each with the lists of all networks
around it. A range is known by its first address. Addresses and range starts are sorted together, and every address takes the lists of
the last start before it: nothing is copied per prefix length, joined or broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logsift.functions.address import mask_hi, mask_lo, parse_address, parse_network
from logsift.plans.shapes import computed_once
from logsift.session import materialize

_NETWORK = ["version", "prefix_len", "hi", "lo"]
_PLACE = ["version", "hi", "lo"]
_LOWEST = -(1 << 63)


def parse_networks(netset: DataFrame) -> DataFrame:
    """``(list_name, cidr, version, prefix_len, hi, lo)``; unparseable CIDRs are skipped."""
    parsed = computed_once(netset, F.col("list_name"), F.col("cidr"), parse_network(F.col("cidr")).alias("net"))
    return parsed.filter(F.col("net").isNotNull()).select("list_name", "cidr", "net.*")


def _covering(places: DataFrame, networks: DataFrame) -> DataFrame:
    """``(version, hi, lo, threat_lists)`` of distinct places: the lists of all networks around each, none if there is none.

    A place is cut to every prefix length in use, so this is for places as few as the networks.
    """
    used: dict[int, list[int]] = {4: [], 6: []}
    for row in networks.select("version", "prefix_len").distinct().collect():  # at most 33 + 129
        used[row["version"]].append(row["prefix_len"])

    def lengths(version: int) -> Column:
        return F.array(*[F.lit(n) for n in sorted(used[version])]).cast("array<int>")

    length = F.col("prefix_len")
    own = [F.col(c).alias(f"own_{c}") for c in _PLACE]
    cut = places.select(*_PLACE, F.explode(F.when(F.col("version") == 4, lengths(4)).otherwise(lengths(6))).alias("prefix_len"))
    cut = cut.select(*own, "version", "prefix_len", mask_hi(F.col("hi"), length).alias("hi"), mask_lo(F.col("lo"), length).alias("lo"))
    found = cut.join(networks, _NETWORK).groupBy(*[F.col(f"own_{c}").alias(c) for c in _PLACE]).agg(F.flatten(F.collect_list("lists")).alias("lists"))
    nothing = F.array().cast("array<string>")
    return places.join(found, _PLACE, "left").select(*_PLACE, F.coalesce(F.array_sort(F.array_distinct("lists")), nothing).alias("threat_lists"))


def _biased(column: str) -> Column:
    """Half of an address as a long whose order is that of the unsigned number."""
    return F.col(column).bitwiseXOR(F.lit(_LOWEST))


def _plus_power(value: Column, exponent: Column) -> Column:
    """``value + 2**exponent`` (exponent 0 to 63) of a biased long; NULL beyond the largest."""
    half = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(exponent - 1, F.lit(0)).cast("int"))
    return F.when(exponent == 0, F.try_add(value, F.lit(1).cast("long"))).otherwise(F.try_add(F.try_add(value, half), half))


def _behind(networks: DataFrame) -> DataFrame:
    """The first place behind each network, in biased halves; networks at the end of the address space have none."""
    length = F.col("prefix_len")
    high = F.when(length > 0, _plus_power(F.col("hi"), F.lit(64) - F.least(length, F.lit(64))))
    low = _plus_power(F.col("lo"), F.lit(128) - F.greatest(F.least(length, F.lit(128)), F.lit(65)))
    carried = F.try_add("hi", F.lit(1).cast("long"))
    lowest = F.lit(_LOWEST).cast("long")
    in_low = length > 64
    return networks.select(
        "version", F.when(~in_low, high).when(low.isNull(), carried).otherwise(F.col("hi")).alias("hi"),
        F.when(in_low & low.isNotNull(), low).otherwise(lowest).alias("lo")).filter(F.col("hi").isNotNull())


def address_ranges(netset: DataFrame) -> DataFrame:
    """Stored ``(version, hi, lo, threat_lists)``: where a range of addresses with other lists begins, up to the next row.

    ``hi`` and ``lo`` are the unsigned halves of the first address less 2**63, so they sort as they are. Both versions begin with a
    row of their own; ``threat_lists`` is empty between networks.
    """
    networks = materialize(parse_networks(netset).groupBy(*_NETWORK).agg(F.collect_set("list_name").alias("lists")), "networks")
    starts = networks.select("version", _biased("hi").alias("hi"), _biased("lo").alias("lo"), "prefix_len")
    lowest = F.lit(_LOWEST).cast("long")
    first = netset.sparkSession.createDataFrame([(4,), (6,)], "version int").select("version", lowest.alias("hi"), lowest.alias("lo"))
    places = starts.select(*_PLACE).unionByName(_behind(starts)).unionByName(first).distinct()
    plain = places.select("version", _biased("hi").alias("hi"), _biased("lo").alias("lo"))
    ranges = _covering(plain, networks)
    return materialize(ranges.select("version", _biased("hi").alias("hi"), _biased("lo").alias("lo"), "threat_lists"), "ranges")


def match_ips(ips: DataFrame, netset: DataFrame, column: str = "ip") -> DataFrame:
    """``(column, threat_lists)`` for every distinct address inside at least one network.

    Range starts and distinct addresses are dealt out together by ranges of the address space and sorted; the last start before an address has its
    lists. What is open at the end of one share is put in front of the next one, one row per share.
    """
    parsed = computed_once(ips.select(column).distinct(), parse_address(F.col(column)).alias("address"), keep=[column])
    addresses = parsed.filter(F.col("address").isNotNull()).select(F.col(column).alias("_asked"), "address.*")
    none = F.lit(None).cast("array<string>")
    rows = address_ranges(netset).withColumn("_asked", F.lit(None).cast("string")).unionByName(
        addresses.select("version", _biased("hi").alias("hi"), _biased("lo").alias("lo"), none.alias("threat_lists"), "_asked"))
    order = [*_PLACE, F.col("_asked").isNotNull()]
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_share", F.spark_partition_id()), "shares")
    start = F.when(F.col("_asked").isNull(), F.struct(*_PLACE, "threat_lists"))
    earlier = Window.orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    # One row per share.
    carried = dealt.groupBy("_share").agg(F.max(start).alias("last")).withColumn("last", F.last("last", ignorenulls=True).over(earlier))
    front = carried.filter("last is not null").select(
        F.lit(0).alias("version"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), "last.threat_lists", F.lit(None).cast("string").alias("_asked"), "_share")
    before = Window.partitionBy("_share").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.unionByName(front).withColumn("threat_lists", F.last("threat_lists", ignorenulls=True).over(before))
    return found.filter(F.col("_asked").isNotNull() & (F.size("threat_lists") > 0)).select(F.col("_asked").alias(column), "threat_lists")


def attach_lists(indicators: DataFrame, netset: DataFrame) -> DataFrame:
    """Indicators with the lists their source address is on; an empty array if none."""
    hits = match_ips(indicators.filter(F.col("source_ip").isNotNull()).select("source_ip"), netset, "source_ip")
    return (
        indicators.drop("threat_lists")
        .join(hits, "source_ip", "left")
        .withColumn("threat_lists", F.coalesce("threat_lists", F.array().cast("array<string>")))
        .select(*indicators.columns)
    )
