import ipaddress
import json
import random

import pytest
from conftest import events_frame
from pyspark.sql import functions as F

from logsift.operators import allowlist, indicators as I, netmatch, templates as T, timeline
from logsift.operators.normalize import alias_view
from logsift.plans import shapes
from logsift.plans.triage import triage
from logsift.session import is_stored, materialize

A, B = "1.2.3.4", "5.6.7.8"


@pytest.fixture
def events(spark):
    return events_frame(spark, [
        ("2024-01-01 00:00:00", A, "GET", 200, "m1"), ("2024-01-01 00:01:00", A, "GET", 404, "m2"),
        ("2024-01-01 00:02:00", A, "POST", 500, "m3"), ("2024-01-01 00:03:00", B, "GET", 200, "m4"),
        ("2024-01-01 00:07:00", B, "GET", 200, "m5"),
    ])


def test_templates(events, rows):
    assert rows(T.top_talkers(events)) == [(A, 3), (B, 2)]
    assert rows(T.top_talkers(events, min_events=3)) == [(A, 3)]
    assert rows(T.error_spikes(events)) == [(A, 404, 1), (A, 500, 1)]
    assert rows(T.event_distribution(events)) == [("GET", 4), ("POST", 1)]
    assert [(str(t), n) for t, n in rows(T.temporal_anomaly(events))] == [("2024-01-01 00:00:00", 4), ("2024-01-01 00:05:00", 1)]
    assert rows(T.source_ip_sequence(events)) == [(A, "GET → GET → POST", 3), (B, "GET → GET", 2)]


def test_null_and_empty_keys(spark, rows):
    df = events_frame(spark, [(None, None, None, 404), (None, None, None, 404), (None, "", "GET", 500), ("1969-12-31 23:59:59", "", None, None)])
    assert rows(T.top_talkers(df)) == [("", 2)]
    assert rows(T.error_spikes(df)) == [(None, 404, 2), ("", 500, 1)]
    assert [(str(t), n) for t, n in rows(T.temporal_anomaly(df))] == [("1969-12-31 23:55:00", 1)]


def test_odd_bucket_width_starts_on_monday(spark, rows):
    df = events_frame(spark, [("2000-01-03 00:05:31",)])
    assert str(rows(T.temporal_anomaly(df, width="7 minutes"))[0][0]) == "2000-01-03 00:00:00"
    assert str(rows(T.temporal_anomaly(df, width="1 week"))[0][0]) == "2000-01-03 00:00:00"


def network(spark, pairs):
    return events_frame(spark, [(None, None, "Network Connection", None, None, p, d) for p, d in pairs])


def test_long_tail(spark, rows):
    df = network(spark, [("chrome", "8.8.8.8")] * 3 + [("notepad", "4.4.4.4")] * 2 + [("a", "1.1.1.1"), ("b", "1.1.1.1"), ("c", "2.2.2.2")])
    got = rows(T.long_tail_analysis(df))
    assert got == [("a", "1.1.1.1", 1, 8), ("b", "1.1.1.1", 1, 8), ("c", "2.2.2.2", 1, 8), ("notepad", "4.4.4.4", 2, 8)]
    nulls = network(spark, [("chrome", "8.8.8.8")] * 2 + [("notepad", "4.4.4.4")] * 2 + [("cmd", "1.1.1.1"), (None, "1.1.1.1"), ("x", None)])
    got = rows(T.long_tail_analysis(nulls, max_rare_count=2))
    assert len(got) == 3 and {r[3] for r in got} == {7}
    assert len(rows(T.long_tail_analysis(nulls, max_rare_count=0))) == 1


def test_sequences(spark, rows):
    same = "2024-01-01 00:00:00"
    df = events_frame(spark, [
        (same, A, "C", None, "m"), (same, A, "A", None, "m"), (same, A, "B", None, "m"), (None, A, "D"), (same, B, None),
        (same, "9.9.9.9", "X", None, "m"), (None, "9.9.9.9", "Y"), (same, "9.9.9.9", "Z", None, None), (None, "9.9.9.9", "W", None, "a"),
    ])
    assert rows(T.source_ip_sequence(df)) == [(A, "A → B → C → D", 4), ("9.9.9.9", "X → Z → W → Y", 4)]
    assert rows(T.source_ip_sequence(df, max_events_per_ip=2, limit=1)) == [(A, "A → B", 2)]
    assert rows(T.source_ip_sequence(df, max_events_per_ip=1, min_events=2)) == []


def test_hot_key_is_ranked_exactly(spark):
    df = spark.range(0, 5000, 1, 16).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('k', id % 50) end as k", "hash(id) as v"
    )
    got = {(r.k, r.v, r.rn) for r in shapes.head_per_group(df, ["k"], [F.asc("v")], 7).collect()}
    pdf = df.toPandas().sort_values("v")
    want = {(k, v, i + 1) for k, g in pdf.groupby("k") for i, v in enumerate(g.v.head(7))}
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [0, 50, 10**6])
def test_split_join_equals_broadcast_join(spark, how, hot_rows):
    left = spark.range(0, 500, 1, 8).selectExpr("if(id % 7 = 6, null, if(id % 3 = 0, 0, id % 20)) as k", "id as v")
    right = spark.range(0, 10).selectExpr("id as k", "id * 2 as w")
    small = shapes.join_keyed(left, right, ["k"], how)
    split = shapes.join_keyed(left, right, ["k"], how, broadcast_rows=9, hot_rows=hot_rows)
    assert small.columns == split.columns
    assert sorted(map(tuple, small.collect()), key=repr) == sorted(map(tuple, split.collect()), key=repr)
    assert "BroadcastHashJoin" in plan(small) and "Exchange hashpartitioning" not in plan(small)


def test_runner_and_aliased_tables(spark, rows):
    raw = spark.createDataFrame(
        [("2024-01-01", A, "404", "GET"), ("2024-01-01", A, "500", "GET"), ("2024-01-01", B, "", "GET")],
        "Timestamp string, Client_IP string, Status string, Method string",
    )
    results = T.run_templates(alias_view(raw), {"top_talkers": {"limit": 1}}, ["top_talkers", "error_spikes"])
    assert set(results) == {"top_talkers", "error_spikes"}
    assert rows(results["top_talkers"]) == [(A, 2)] and rows(results["error_spikes"]) == [(A, 404, 1), (A, 500, 1)]
    everything = T.run_templates(alias_view(spark.sql("select 1 as foo")))
    assert len(everything) == 6 and all(df.isEmpty() for n, df in everything.items() if n != "error_spikes")


def test_severities(spark):
    def scored(name, columns, threshold):
        df = spark.sql(f"select {columns}")
        return I.to_indicators(df, name, threshold).head()

    top = scored("top_talkers", "'1.1.1.1' as source_ip, 200L as event_count", 100)
    assert (top.severity, top.description, top.match_ip) == ("High", "IP 1.1.1.1 generated 200 events", "1.1.1.1")
    assert json.loads(top.evidence) == {"source_ip": "1.1.1.1", "event_count": 200}
    err = scored("error_spikes", "cast(null as string) as source_ip, 404 as status_code, 60L as error_count", 50)
    assert (err.severity, err.description) == ("Medium", "IP None returned HTTP 404 60 times")
    assert json.loads(err.evidence)["source_ip"] is None
    dist = scored("event_distribution", "'GET' as event_type, 5L as event_count", 100)
    assert (dist.severity, dist.description, dist.match_ip) == ("Low", "Event type 'GET' occurred 5 times", None)
    bucket = scored("temporal_anomaly", "timestamp_ntz'2024-01-01 00:05:00' as time_bucket, 3L as event_count", 0)
    assert (bucket.severity, bucket.description) == ("Low", "Time bucket 2024-01-01 00:05:00 had 3 events")
    pair = "'p' as process_name, '8.8.8.8' as destination_ip, {}L as connection_count, 9L as total_connections"
    assert scored("long_tail_analysis", pair.format(1), 2).severity == "High"
    rare = scored("long_tail_analysis", pair.format(2), 2)
    assert (rare.severity, rare.match_ip, rare.source_ip) == ("Medium", "8.8.8.8", None)
    assert rare.description == "Process 'p' made 2 connection(s) to 8.8.8.8 (of 9 total)"
    other = scored("custom", "0L as event_count, 7L as error_count", 5)
    assert other.severity == "Medium" and other.description.startswith("Indicator of type custom: {")


def test_severity_domain(spark):
    good = spark.sql("select 'High' as severity")
    assert I.check_severity(good).head()[0] == "High"
    with pytest.raises(Exception, match="Severity must be"):
        I.check_severity(spark.sql("select 'Severe' as severity")).collect()


ALLOW = "id string, indicator string, indicator_type string, description string, metadata string, created_at timestamp_ntz"


def entries(spark, *values):
    data = [(str(i), v, t, None, None, None) for i, (v, t) in enumerate(values)]
    return spark.createDataFrame(data, ALLOW)


def test_allowlisted_indicators_are_dropped_after_the_limit(spark, events):
    both = events.unionByName(network(spark, [("p", "8.8.8.8"), ("p", "9.9.9.9")]))
    listed = entries(spark, (A, "ip"), ("8.8.8.8", "ip"), (B, "hash"))
    found = triage(both, listed, template_thresholds={"top_talkers": {"limit": 1}})
    kept = {(r.type, r.match_ip) for r in found.collect()}
    assert ("top_talkers", A) not in kept and ("top_talkers", B) not in kept
    assert ("source_ip_sequence", B) in kept and ("long_tail_analysis", "9.9.9.9") in kept
    assert ("long_tail_analysis", "8.8.8.8") not in kept
    assert {t for t, _ in kept} >= {"event_distribution", "temporal_anomaly"}
    early = triage(both, listed, template_thresholds={"top_talkers": {"limit": 1}}, allowlist_before_limit=True)
    assert ("top_talkers", B) in {(r.type, r.match_ip) for r in early.collect()}


def test_triage_of_nothing(spark, events):
    assert triage(events.limit(0)).isEmpty()


def test_threat_lists_are_attached_by_source_address(spark):
    found = spark.createDataFrame(
        [("top_talkers", "10.0.0.1"), ("top_talkers", "192.168.1.1"), ("temporal_anomaly", None)], "type string, source_ip string"
    ).withColumn("threat_lists", F.array().cast("array<string>"))
    nets = spark.createDataFrame([("level2", "10.0.0.0/16"), ("level1", "10.0.0.0/8"), ("level1", "10.0.0.1")], "list_name string, cidr string")
    got = {(r.type, r.source_ip): r.threat_lists for r in netmatch.attach_lists(found, nets).collect()}
    assert got == {("top_talkers", "10.0.0.1"): ["level1", "level2"], ("top_talkers", "192.168.1.1"): [], ("temporal_anomaly", None): []}


def test_matching_equals_brute_force(spark):
    rng = random.Random(7)
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)]
    ips += [f"10.{rng.randrange(4)}.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(200)]
    ips += [str(ipaddress.IPv6Address((0x20010DB8 << 96) | rng.getrandbits(20) << 76 | rng.getrandbits(30))) for _ in range(200)]
    ips += ["bad", "1.2.3", "", "010.0.0.1", "::ffff:10.0.0.1", "10.0.0.1"]
    nets = [(f"l{rng.randrange(5)}", f"10.{rng.randrange(4)}.{rng.randrange(4)}.{rng.randrange(256)}/{rng.randrange(8, 33)}") for _ in range(60)]
    nets += [(f"l{rng.randrange(5)}", f"2001:db8:{rng.getrandbits(16):x}::/{rng.randrange(20, 60)}") for _ in range(40)]
    nets += [("any6", "::/1"), ("half", "128.0.0.0/1"), ("junk", "nope"), ("mask", "10.1.0.0/255.255.0.0"), ("host", "10.0.0.1")]
    parsed = []
    for name, cidr in nets:
        try:
            parsed.append((name, ipaddress.ip_network(cidr, strict=False)))
        except ValueError:
            pass
    want = {}
    for ip in ips:
        try:
            address = ipaddress.ip_address(ip)
        except ValueError:
            continue
        names = sorted({n for n, net in parsed if net.version == address.version and address in net})
        if names:
            want[ip] = names
    ip_frame = spark.createDataFrame([(i,) for i in ips * 2], "ip string")
    net_frame = spark.createDataFrame(nets, "list_name string, cidr string")
    got = {r.ip: r.threat_lists for r in netmatch.match_ips(ip_frame, net_frame).collect()}
    assert got == want
    everything = spark.createDataFrame([("all", "0.0.0.0/0")], "list_name string, cidr string")
    assert netmatch.match_ips(ip_frame, everything).count() == len({i for i in ips if i.count(".") == 3 and ":" not in i and not i.startswith("0")})


def test_allowlist_table(spark, rows):
    stored = entries(spark, (A, "ip"), (A, "hash"))
    new = spark.createDataFrame(
        [("n1", A, "ip"), ("n3", B, "ip"), ("n2", B, "ip"), ("n4", A, "domain"), ("n4", A, "domain")], "id string, indicator string, indicator_type string"
    ).selectExpr("*", "cast(null as string) as description", "cast(null as string) as metadata", "timestamp_ntz'2024-01-01' as created_at")
    accepted, rejected = allowlist.insert(stored, new)
    assert sorted(r.id for r in accepted.collect()) == ["n2", "n4"]
    assert sorted(r.id for r in rejected.collect()) == ["n1", "n3", "n4"]
    assert allowlist.delete(stored, spark.createDataFrame([("0",), ("nope",)], "id string")).count() == 1
    assert [r.id for r in allowlist.listing(stored, "hash").collect()] == ["1"] and allowlist.listing(stored.limit(0)).isEmpty()
    some = spark.createDataFrame([(A,), (B,), (A,), (None,)], "indicator string")
    flags = sorted(rows(allowlist.membership(some, stored, indicator_type="ip")), key=repr)
    assert flags == [(A, True), (A, True), (B, False), (None, False)]
    checked, invalid = allowlist.canonical_entries(entries(spark, (" 2001:DB8::0 ", "ip"), ("010.1.1.1", "ip"), ("Anything", "domain")))
    assert sorted(r.indicator for r in checked.collect()) == ["2001:db8::", "Anything"]
    assert [r.indicator for r in invalid.collect()] == ["010.1.1.1"]
    stamped = allowlist.with_defaults(stored, F.lit("2024-05-05 00:00:00"))
    assert {str(r.created_at) for r in stamped.collect()} == {"2024-05-05 00:00:00"}


def test_timeline_metrics(spark):
    df = events_frame(spark, [
        ("2024-01-01 00:00:00", A, "GET", 200), ("2024-01-02 02:05:03", B, "GET", 404), (None, "9.9.9.9", "POST", 500),
    ])
    row = timeline.metrics(df).head()
    assert (row.total_events, row.unique_source_ips, row.error_count, row.error_rate_pct, row.duration) == (3, 3, 2, 66.7, "1d 2h 5m 3s")
    empty = timeline.metrics(df.limit(0)).head()
    assert (empty.total_events, empty.error_count, empty.error_rate_pct, empty.duration, empty.first_event) == (0, 0, 0.0, None, None)
    texts = spark.createDataFrame([("200 OK",), ("N/A",), ("404",), ("",)], "status_code string")
    summary, shown = timeline.build_timeline(texts)
    assert summary.head()["error_rate_pct"] == 25.0 and sorted(r.status_code or 0 for r in shown.collect()) == [0, 0, 0, 404]
    only_time = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "event_timestamp string")
    row = timeline.build_timeline(only_time)[0].head()
    assert (row.total_events, row.unique_source_ips, row.error_count, row.duration) == (2, 0, 0, "1d")


def test_timeline_rows_and_filters(events, rows):
    options = timeline.TimelineOptions(limit=2, source_ip=A, min_status=400)
    summary, shown = timeline.build_timeline(events, options)
    assert summary.head()["total_events"] == 2 and [r.status_code for r in shown.collect()] == [404, 500]
    assert timeline.apply_filters(events, timeline.TimelineOptions(source_ip=[], event_type=[])).count() == 5
    assert timeline.apply_filters(events, timeline.TimelineOptions(event_type=["POST", "PUT"])).count() == 1
    assert timeline.apply_filters(events, timeline.preset_options(">= 5xx", source_ip=[A])).count() == 1
    assert [r.raw_message for r in timeline.recent_rows(timeline.rows(events), 2).collect()] == ["m5", "m4"]
    ips, types = timeline.filter_options(events)
    assert rows(ips) == [(A, 3), (B, 2)] and rows(types) == [("GET",), ("POST",)]
    point = timeline.points(timeline.rows(events_frame(events.sparkSession, [(None, "", None, None, None)]))).head()
    assert tuple(point) == (None, "unknown", "N/A", None, "", "unknown")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_at_scale(spark, events, tmp_path):
    events.write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    nets = spark.createDataFrame([("l", "10.0.0.0/8")], "list_name string, cidr string")
    for name, df in {**T.run_templates(stored), "match": netmatch.match_ips(stored.select(F.col("source_ip").alias("ip")), nets)}.items():
        text = plan(df)
        assert "NestedLoop" not in text and "CartesianProduct" not in text, name
        assert "PythonEval" not in text and "ArrowEval" not in text, name
    top = plan(T.top_talkers(stored))
    assert "TakeOrderedAndProject" in top and "partial_count" in top and "ReadSchema: struct<source_ip:string>" in top
    assert "PushedFilters: [IsNotNull(status_code), GreaterThanOrEqual(status_code,400)]" in plan(T.error_spikes(stored))
    assert plan(T.ranked_events(stored)).count("WindowGroupLimit") == 4


def covering_lists(ip: str, nets: dict) -> list:
    """Lists of all networks around an address, by cutting it to every length."""
    address = ipaddress.ip_address(ip)
    found = set()
    for length in range(address.max_prefixlen + 1):
        found |= nets.get((address.version, length, int(address) >> (address.max_prefixlen - length) if length else 0), set())
    return sorted(found)


def network_table(nets: list[tuple]) -> dict:
    table = {}
    for name, cidr in nets:
        net = ipaddress.ip_network(cidr)
        table.setdefault((net.version, net.prefixlen, int(net.network_address) >> (net.max_prefixlen - net.prefixlen) if net.prefixlen else 0), set()).add(name)
    return table


def check_matches(spark, nets, ips):
    table = network_table(nets)
    got = {r.ip: r.threat_lists for r in netmatch.match_ips(
        spark.createDataFrame([(i,) for i in ips], "ip string"), spark.createDataFrame(nets, "list_name string, cidr string")).collect()}
    assert got == {ip: lists for ip in ips if (lists := covering_lists(ip, table))}


def test_networks_at_the_ends_of_the_address_space(spark):
    nets = [("all4", "0.0.0.0/0"), ("low", "0.0.0.0/1"), ("last", "255.255.255.255/32"), ("first", "0.0.0.0/32"), ("high", "128.0.0.0/2"),
            ("six", "8000::/1"), ("mid", "2001:db8::/64"), ("fine", "2001:db8::8000:0:0:0/65"), ("host", "2001:db8::ffff:ffff:ffff:ffff/128"), ("end", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff/128")]
    ips = ["0.0.0.0", "0.0.0.1", "127.255.255.255", "128.0.0.0", "191.255.255.255", "192.0.0.0", "255.255.255.254", "255.255.255.255", "::", "::1", "7fff::1", "8000::", "2001:db8::",
           "2001:db8::7fff:ffff:ffff:ffff", "2001:db8::8000:0:0:0", "2001:db8::ffff:ffff:ffff:ffff", "2001:db8:0:1::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "fe80::1"]
    check_matches(spark, nets, ips)
    check_matches(spark, nets[1:5], ips)
    check_matches(spark, nets[:1], ips)
    assert netmatch.match_ips(spark.createDataFrame([], "ip string"), spark.createDataFrame(nets, "list_name string, cidr string")).count() == 0
    assert netmatch.match_ips(spark.createDataFrame([("1.1.1.1",)], "ip string"), spark.createDataFrame([], "list_name string, cidr string")).count() == 0


def test_a_hundred_thousand_nested_networks(spark):
    rng = random.Random(9)
    nets, ips = [], set()
    for i in range(100_000):
        length = rng.randrange(4, 33)
        value = rng.getrandbits(32) if i % 3 else 0x0A000000 | rng.getrandbits(12) << 8
        nets.append((f"l{i % 50}", str(ipaddress.ip_network((value >> (32 - length) << (32 - length), length)))))
        if i % 100 == 0:
            ips |= {str(ipaddress.ip_address(value)), str(ipaddress.ip_address(rng.getrandbits(32)))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_matches(spark, nets, sorted(ips))
        plan = netmatch.match_ips(spark.createDataFrame([(i,) for i in ips], "ip string"), spark.createDataFrame(nets[:1000], "list_name string, cidr string"))
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_events_are_read_once(spark, events, tmp_path, monkeypatch):
    network(spark, [("p", "8.8.8.8"), ("p", None)]).write.parquet(str(tmp_path / "n"))
    events.write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "n"))
    assert plan(T.long_tail_analysis(stored)).count("FileScan") == 1
    assert plan(timeline.preset_counts(stored)).count("FileScan") == 1
    assert sorted(map(tuple, timeline.preset_counts(events).collect())) == [(">= 3xx", 2), (">= 4xx", 2), (">= 5xx", 1), ("All", 5)]
    # Stored events are not copied, computed ones are.
    written = []
    monkeypatch.setattr("logsift.plans.triage.materialize", lambda df, label: written.append(label) or materialize(df, label))
    stored_events = spark.read.parquet(str(tmp_path / "e"))
    assert is_stored(stored_events) and is_stored(stored_events.select("source_ip")) and not is_stored(stored_events.filter("source_ip = 'x'")) and not is_stored(events)
    triage(stored_events)
    assert "events" not in written
    triage(stored_events.withColumn("source_ip", F.lower("source_ip")))
    assert written.count("events") == 1
