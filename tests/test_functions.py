import ipaddress

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from logsift.functions import text
from logsift.functions.address import canonical_address, parse_address, parse_network
from logsift.functions.casts import event_time, status_number

TIMES = [
    ("14/Nov/2023:12:00:00 +0000", "2023-11-14 12:00:00"),
    ("14/Nov/2023:14:00:00 +0200", "2023-11-14 12:00:00"),
    ("14/Nov/2023:14:00:00 +02:00", "2023-11-14 12:00:00"),
    ("14/Nov/2023:14:00:00 Z", None),
    ("31/Feb/2024:00:00:00 +0000", None),
    ("Jan 15 08:00:00", "1900-01-15 08:00:00"),
    ("Jan  5 08:00:00", "1900-01-05 08:00:00"),
    ("2024-01-01 10:00:00", "2024-01-01 10:00:00"),
    ("2024-1-2 3:4:5", "2024-01-02 03:04:05"),
    ("2024-01-01T00:00:00Z", "2024-01-01 00:00:00"),
    ("2024-01-01T00:00:00+0200", "2023-12-31 22:00:00"),
    ("2024-01-01T00:00:00.123456Z", "2024-01-01 00:00:00.123456"),
    ("2024-01-01 00:00:00 +02", None),
    ("2024/01/02 10:00:00", "2024-01-02 10:00:00"),
    ("2024-01-01", "2024-01-01 00:00:00"),
    ("1431433200", "2015-05-12 12:20:00"),
    (" 1431433200 ", "2015-05-12 12:20:00"),
    ("2024", "1970-01-01 00:33:44"),
    ("10:00:00", None),
    ("99999999999999999", None),
    ("", None),
    ("soon", None),
    (None, None),
]


def test_event_time_shapes(spark):
    df = spark.createDataFrame([(t,) for t, _ in TIMES], "t string")
    got = df.select("t", event_time(F.col("t"), T.StringType()).cast("string").alias("v")).collect()
    assert [(r.t, r.v) for r in got] == TIMES


def test_event_time_of_typed_columns(spark):
    df = spark.sql("select 1431433200 as i, cast(1431433200.5 as double) as d, timestamp_ntz'2024-01-01 00:00:00' as n, "
                   "timestamp'2024-01-01 00:00:00' as z, date'2024-01-02' as day, true as b")
    values = df.select(*[event_time(F.col(f.name), f.dataType).cast("string").alias(f.name) for f in df.schema.fields]).head()
    assert tuple(values) == ("2015-05-12 12:20:00", "2015-05-12 12:20:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00",
                             "2024-01-02 00:00:00", None)


def test_status_number(spark):
    texts = ["404", " 404 ", "200 OK", "", "N/A", "200.6", "4e2", "99999999999", "NaN", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(status_number(F.col("t"), T.StringType(), "int")).collect()]
    assert got == [404, 404, None, None, None, 201, 400, None, None, None]
    assert spark.range(1).select(status_number(F.lit(2.5), T.DoubleType(), "bigint")).head()[0] == 2


ADDRESSES = [
    "1.2.3.4", "01.2.3.4", "1.2.3", "1.2.3.256", "::", "::1", "1::", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "1.2.3.4%x",
    "::ffff:1.2.3.4", "::1.2.3.4", "64:ff9b::1.2.3.400", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
    "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:7:8:9", ":1::2", "1::2::3", "12345::", "g::", "2001:DB8::00A0", "0:0:1:0:0:0:2:3",
    "1:0:0:2:0:0:3:4", "", "abc", "1:2:3:4:5:6:1.2.3.4", ":::", "1:::2", "0:0:0:0:0:ffff:0:0", None,
]


def _address(text_value):
    try:
        return ipaddress.ip_address(text_value)
    except ValueError:
        return None


def _expected(address):
    if address is None:
        return None
    number = int(address)
    return (4, number << 32, 0) if address.version == 4 else (6, number >> 64, number & (2**64 - 1))


def _check_addresses(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", parse_address(F.col("t")).alias("p"), canonical_address(F.col("t")).alias("c")).collect():
        address = None if r.t is None else _address(r.t)
        got = None if r.p is None else (r.p.version, r.p.hi % 2**64, r.p.lo % 2**64)
        assert got == _expected(address), r.t
        assert r.c == (None if address is None else str(address)), r.t


def test_addresses(spark):
    _check_addresses(spark, ADDRESSES)


_group = st.one_of(st.just("0"), st.integers(0, 65535).map(lambda n: f"{n:x}"), st.integers(0, 65535).map(lambda n: f"{n:04X}"))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(_group, min_size=8, max_size=8), st.integers(0, 8), st.integers(0, 8)), min_size=20, max_size=40))
def test_random_v6_addresses(spark, cases):
    texts = []
    for groups, start, end in cases:
        texts.append(":".join(groups))
        low, high = sorted((start, end))
        texts.append(":".join(groups[:low]) + "::" + ":".join(groups[high:]))
    _check_addresses(spark, texts)


def test_networks(spark):
    texts = [
        "10.0.0.0/8", "10.1.2.3/16", "1.2.3.4", "0.0.0.0/0", "::/0", "2001:db8::/32", "2001:db8::1", "10.0.0.0/255.0.0.0",
        "10.0.0.0/0.0.0.255", "10.0.0.0/255.0.255.0", "10.0.0.0/33", "::/129", "a/b", "1.2.3.4/", "1.2.3.4/8/8", "::1/ffff::",
        "10.0.0.0/08", "10.0.0.0/-1", "2001:db8:ffff:ffff:ffff::/65", "2001:db8::1/127", "10.0.0.0/0.0.0.0",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", parse_network(F.col("t")).alias("p")).collect():
        try:
            net = ipaddress.ip_network(r.t, strict=False)
        except ValueError:
            net = None
        got = None if r.p is None else (r.p.version, r.p.prefix_len, r.p.hi % 2**64, r.p.lo % 2**64)
        want = None
        if net is not None:
            version, hi, lo = _expected(net.network_address)
            want = (version, net.prefixlen, hi, lo)
        assert got == want, r.t


def test_durations(spark):
    cases = [(0, "0s"), (-5, "0s"), (3, "3s"), (60, "1m"), (3600, "1h"), (86400, "1d"), (93903, "1d 2h 5m 3s"), (86403, "1d 3s")]
    df = spark.createDataFrame(cases, "s long, want string")
    first = F.timestamp_seconds(F.lit(1_000_000)).cast("timestamp_ntz")
    last = F.timestamp_seconds(F.lit(1_000_000) + F.col("s")).cast("timestamp_ntz")
    assert all(r.want == r.got for r in df.select("want", text.duration_text(first, last).alias("got")).collect())
    assert df.select(text.duration_text(F.lit(None).cast("timestamp_ntz"), last)).head()[0] is None


def test_sizes_labels_and_truncation(spark):
    one = spark.range(1)
    sizes = [one.select(text.size_text(F.lit(n))).head()[0] for n in (0, 1023, 1024, 1280, 1536, 1048576, 5 * 1048576)]
    assert sizes == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.5 KB", "1.0 MB", "5.0 MB"]
    assert one.select(text.is_large(F.lit(100 * 1024 * 1024 + 1))).head()[0]
    assert one.select(text.truncate_message(F.lit("x" * 81))).head()[0] == "x" * 80 + "..."
    assert one.select(text.truncate_message(F.lit("x" * 80))).head()[0] == "x" * 80
    assert one.select(text.truncate_within(F.lit("x" * 11), 10)).head()[0] == "x" * 9 + "…"
    labels = one.select(text.date_label(F.lit("2024-01-02T10:00:00")), text.date_label(F.lit(None).cast("string"))).head()
    assert tuple(labels) == ("2024-01-02", "unknown")
    classes = [one.select(text.status_class(F.lit(s).cast("int"))).head()[0] for s in (None, 200, 302, 404, 500)]
    assert classes == ["unknown", "success", "redirect", "client_error", "server_error"]


def test_identifiers(spark):
    names = ["auth.log", "1st", "", "ok_name", "a b-c"]
    want = ["auth_log", "_1st", "_", "ok_name", "a_b_c"]
    assert [text.sanitize_identifier(n) for n in names] == want
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.sanitized(F.col("n"))).collect()] == want
    assert text.check_identifier("abc_1") == "abc_1"
    for bad in ("", "1a", "a b", 'x"y'):
        with pytest.raises(ValueError):
            text.check_identifier(bad)
    name = text.raw_table_name("/in/web access.log", "log")
    assert name.startswith("raw_log_web_access_") and name == text.raw_table_name("/in/web access.log", "log")
    assert text.raw_table_name("/in/x.log", "log", "my table") == "my_table"
