"""IP addresses and networks as column expressions.

An address becomes (version, hi, lo): two signed longs holding 128 bits, an IPv4
address left-aligned in ``hi``. A network is the same pair with its host bits
cleared plus a prefix length, so containment is equality of masked pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_V4_TAIL = rf"^(.*:){_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_GROUPS = 8


def _quad_number(text: Column) -> Column:
    """The value of a text known to be a dotted quad."""
    part = [F.substring_index(F.substring_index(text, ".", i + 1), ".", -1).try_cast("bigint") for i in range(4)]
    return part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3]


def _v4_number(text: Column) -> Column:
    """A valid dotted quad as a long, else NULL."""
    return F.when(text.rlike(_V4), _quad_number(text))


def _without_scope(text: Column) -> Column:
    """Drop an IPv6 zone (``%eth0``); a malformed zone makes the address invalid."""
    return F.when(text.contains("%") & ~text.rlike(r"^[^%]*:[^%]*%[^%]+$"), F.lit(None)).otherwise(
        F.substring_index(text, "%", 1)
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v6_full(text: Column) -> Column:
    """All eight groups of an IPv6 text, lower case, joined by colons; NULL if invalid."""

    def hex_tail(plain: Column) -> Column:
        octet = [F.regexp_extract(plain, _V4_TAIL, i + 2).try_cast("bigint") for i in range(4)]
        groups = F.hex(octet[0] * 256 + octet[1]), F.hex(octet[2] * 256 + octet[3])
        return F.concat(F.regexp_extract(plain, _V4_TAIL, 1), groups[0], F.lit(":"), groups[1])

    def count_groups(part: Column) -> Column:
        return F.when(part == "", 0).otherwise(F.length(part) - F.length(F.replace(part, F.lit(":"), F.lit(""))) + 1)

    def filled(plain: Column) -> Column:
        head, rest = F.substring_index(plain, "::", 1), F.substring_index(plain, "::", -1)
        skipped = F.lit(_GROUPS) - count_groups(head) - count_groups(rest)
        zeros = F.repeat(F.lit(":0"), skipped)
        joined = F.concat_ws(":", F.nullif(head, F.lit("")), F.substring(zeros, 2, 2 * _GROUPS), F.nullif(rest, F.lit("")))
        one_gap = F.length(F.replace(plain, F.lit("::"), F.lit(""))) == F.length(plain) - 2
        return F.when(~plain.contains("::"), plain).when(
            one_gap & ~plain.contains(":::") & (skipped >= 1), joined
        )

    def valid(full: Column) -> Column:
        return F.when(full.rlike(rf"^([0-9a-f]{{1,4}}:){{{_GROUPS - 1}}}[0-9a-f]{{1,4}}$"), full)

    plain = _without_scope(text)
    expanded = F.when(plain.contains("."), _let(plain, hex_tail)).otherwise(plain)
    return _let(_let(F.when(plain.contains(":"), F.lower(expanded)), filled), valid)


def _v6_numbers(full: Column) -> Column:
    """The version struct of eight joined groups."""

    def halves(digits: Column) -> Column:
        hi, lo = [F.conv(F.substring(digits, start, 16), 16, -10).cast("bigint") for start in (1, 17)]
        return F.when(digits.isNotNull(), F.struct(F.lit(6).alias("version"), hi.alias("hi"), lo.alias("lo")))

    padded = F.replace(F.concat(F.lit(":"), full), F.lit(":"), F.lit(":000"))
    return _let(F.regexp_replace(padded, ":0*([0-9a-f]{4})(?=:|$)", "$1"), halves)


def parse_address(text: Column) -> Column:
    """struct<version:int, hi:bigint, lo:bigint>; NULL for anything that is not an address."""
    v4 = F.struct(
        F.lit(4).alias("version"),
        F.shiftleft(_quad_number(text), 32).alias("hi"),
        F.lit(0).cast("bigint").alias("lo"),
    )
    return F.when(text.rlike(_V4), v4).when(text.contains(":"), _v6_numbers(_v6_full(text)))


def mask_hi(hi: Column, length: Column) -> Column:
    all_bits = F.lit(-1).cast("bigint")
    mask = F.when(length <= 0, F.lit(0).cast("bigint")).when(length >= 64, all_bits)
    return hi.bitwiseAND(mask.otherwise(F.call_function("shiftleft", all_bits, (F.lit(64) - length).cast("int"))))


def mask_lo(lo: Column, length: Column) -> Column:
    all_bits = F.lit(-1).cast("bigint")
    mask = F.when(length <= 64, F.lit(0).cast("bigint")).when(length >= 128, all_bits)
    return lo.bitwiseAND(mask.otherwise(F.call_function("shiftleft", all_bits, (F.lit(128) - length).cast("int"))))


def _dotted_prefix(text: Column) -> Column:
    """Prefix length of a dotted netmask (255.255.0.0) or hostmask (0.0.255.255); NULL if neither."""
    bits = F.lpad(F.bin(_v4_number(text)), 32, "0")
    ones = F.length(F.regexp_replace(bits, "0", ""))
    return F.when(bits.rlike("^1*0*$"), ones).when(bits.rlike("^0*1*$"), F.lit(32) - ones)


def parse_network(cidr: Column) -> Column:
    """struct<version, prefix_len, hi, lo> of a CIDR text, host bits cleared; NULL if unparseable.

    A bare address is a single-host network; IPv4 accepts dotted masks as well.
    """
    suffix = F.substring_index(cidr, "/", -1)
    number = F.when(suffix.rlike("^[0-9]{1,4}$"), suffix.try_cast("int"))

    def with_length(address: Column) -> Column:
        width = F.when(address["version"] == 4, 32).otherwise(128)
        length = F.when(~cidr.contains("/"), width).otherwise(
            F.coalesce(number, F.when(address["version"] == 4, _let(suffix, _dotted_prefix)))
        )
        return F.when(
            address.isNotNull() & ~cidr.rlike("/.*/") & (length <= width),
            F.struct(address.alias("address"), length.cast("int").alias("length")),
        )

    def masked(net: Column) -> Column:
        return F.when(
            net.isNotNull(),
            F.struct(
                net["address"]["version"].alias("version"),
                net["length"].alias("prefix_len"),
                mask_hi(net["address"]["hi"], net["length"]).alias("hi"),
                mask_lo(net["address"]["lo"], net["length"]).alias("lo"),
            ),
        )

    return _let(_let(parse_address(F.substring_index(cidr, "/", 1)), with_length), masked)


def canonical_address(text: Column) -> Column:
    """Normal text form of an address (trimmed); NULL if it is not one.

    IPv6 is lower case without leading zeros, the first longest run of at least two
    zero groups is written ``::``, and a mapped IPv4 address keeps its dotted tail.
    """

    def shortened(joined: Column) -> Column:
        short = joined
        for run in range(2, _GROUPS + 1):
            zeros = rf"^(.*?)(^|:)0(?::0){{{run - 1}}}(:|$)(.*)$"
            short = F.when(joined.rlike(zeros), F.regexp_replace(joined, zeros, "$1::$4")).otherwise(short)
        return short

    def plain_groups(full: Column) -> Column:
        return F.regexp_replace(full, "(^|:)0{1,3}(?=[0-9a-f])", "$1")

    def v6_text(joined: Column) -> Column:
        low = [F.conv(F.get(F.split(joined, ":"), F.lit(i)), 16, 10).cast("bigint") for i in (6, 7)]
        parts = [part for n in low for part in (F.shiftright(n, 8), F.pmod(n, F.lit(256)))]
        dotted = F.concat_ws(".", *[part.cast("string") for part in parts])
        return F.when(joined.startswith("0:0:0:0:0:ffff:"), F.concat(F.lit("::ffff:"), dotted)).otherwise(
            _let(joined, shortened)
        )

    value = F.trim(text)
    zone = F.when(value.contains("%"), F.concat(F.lit("%"), F.substring_index(value, "%", -1))).otherwise("")
    return F.when(value.rlike(_V4), value).when(
        value.contains(":"), F.concat(_let(plain_groups(_v6_full(value)), v6_text), zone)
    )
