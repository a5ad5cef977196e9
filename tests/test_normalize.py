import pytest
from pyspark.sql import functions as F

from logsift.constants import EVENT_COLUMNS
from logsift.operators import normalize as N
from logsift.plans.store import EventStore, describe_tables, raw_tables, replace_events
from logsift.session import shared_dir
from logsift.sources.tabular import csv_layouts
from logsift.sources import adapters
from logsift.streaming import ingest
from logsift.streaming.ingest import stream_detected_text, stream_table_files, stream_text_files, streamed_events


def test_csv_columns_are_mapped(spark):
    raw = spark.createDataFrame(
        [("2024-01-01T00:00:00", "1.2.3.4", "200", "GET"), ("bad", "5.6.7.8", "x", "POST")],
        "timestamp string, client_ip string, status string, method string",
    )
    events, mapping = N.normalize(raw)
    assert events.columns == list(EVENT_COLUMNS) and dict(events.dtypes)["status_code"] == "int"
    assert mapping["source_ip"] == "client_ip" and mapping["event_type"] == "method" and mapping["raw_message"] is None
    assert [(str(r.event_timestamp), r.status_code) for r in events.collect()] == [("2024-01-01 00:00:00", 200), ("None", None)]


def test_json_columns_are_mapped(spark):
    raw = spark.sql("select '2024-01-01 10:00:00' as time, '9.8.7.6' as remote_addr, 'login' as action, 201 as response_code, "
                    "'User logged in' as message")
    row = N.normalize(raw)[0].head()
    assert (row.source_ip, row.status_code, row.event_type, row.raw_message) == ("9.8.7.6", 201, "login", "User logged in")


def test_first_match_and_coalesce(spark):
    raw = spark.sql("select 'bad' as timestamp, '2024-01-01' as time, cast(null as string) as client_ip, '1.1.1.1' as ip, "
                    "'n/a' as status, '404' as code, named_struct('a', 1) as message")
    row = N.normalize(raw)[0].head()
    assert row.event_timestamp is None and row.source_ip == "1.1.1.1" and row.status_code == 404 and row.raw_message == '{"a":1}'


def test_unknown_and_line_only_tables(spark):
    unknown = spark.sql("select 1 as foo, 2 as bar")
    assert tuple(N.normalize(unknown)[0].head()) == (None,) * 7
    assert not N.is_analyzable(unknown.columns) and N.is_analyzable(["x", "SRC_IP"])
    text = spark.createDataFrame([("line one",), ("line two",)], "line string")
    assert N.is_unstructured(text)
    assert [r.raw_message for r in N.normalize(text)[0].collect()] == ["line one", "line two"]


def test_custom_aliases_and_case(spark):
    raw = spark.sql("select 'x' as WHO, '1.1.1.1' as Client_IP")
    assert N.find_matches(raw.columns, "source_ip") == ["Client_IP"]
    assert N.normalize(raw, {"source_ip": ["who"]})[0].head()["source_ip"] == "x"
    assert {"timestamp", "dst_ip", "event_type"} <= N.all_aliases()


def test_alias_view_prefers_exact_names(spark):
    raw = spark.sql("select '2024-01-01' as timestamp, '2024-02-02' as Event_Timestamp, ' 404 ' as Status")
    row = N.alias_view(raw).head()
    assert str(row.event_timestamp) == "2024-02-02 00:00:00" and row.status_code == 404
    assert dict(N.alias_view(raw).dtypes)["status_code"] == "bigint"
    assert str(N.normalize(raw)[0].head().event_timestamp) == "2024-01-01 00:00:00"


def source(spark, *ips):
    return spark.createDataFrame([(ip, "GET") for ip in ips], "client_ip string, method string")


def test_batches_are_added_once_per_source(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    assert store.events().count() == 0
    a, b = source(spark, "1.1.1.1", "1.1.1.1"), source(spark, "2.2.2.2")
    assert store.append({"a": a}) == ["a"]
    assert store.append({"a": a, "b": b}) == ["b"]
    assert store.append({"a": a, "b": b}) == []
    assert sorted(r.source_ip for r in store.events().collect()) == ["1.1.1.1", "1.1.1.1", "2.2.2.2"]


def test_unfinished_source_is_hidden_and_replaced(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    store.append({"a": source(spark, "1.1.1.1")})
    store._write(N.normalize_all({"b": source(spark, "2.2.2.2")}))  # lost before it was entered
    assert [r.source for r in store.events().collect()] == ["a"]
    store.append({"b": source(spark, "2.2.2.2")})
    assert sorted(r.source for r in store.events().collect()) == ["a", "b"]


def test_unstructured_sources_need_the_flag(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    text = spark.createDataFrame([("x",)], "line string")
    assert store.append({"t": text}) == []
    assert store.append({"t": text}, include_unstructured=True) == ["t"]
    with pytest.raises(ValueError):
        N.normalize_all({"t": text})


def test_rebuild_and_replace(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "store"))
    store.append({"a": source(spark, "1.1.1.1"), "b": source(spark, "2.2.2.2")})
    store.rebuild({"a": source(spark, "3.3.3.3")})
    assert [(r.source, r.source_ip) for r in store.events().collect()] == [("a", "3.3.3.3")]
    assert store.append({"a": source(spark, "9.9.9.9")}) == []
    path = str(tmp_path / "one")
    replace_events(source(spark, "1.1.1.1"), path)
    mapping, events = replace_events(source(spark, "2.2.2.2"), path)
    assert mapping["source_ip"] == "client_ip" and [r.source_ip for r in events.collect()] == ["2.2.2.2"]


def test_a_lost_rebuild_leaves_the_old_events(spark, tmp_path, monkeypatch):
    store = EventStore(spark, str(tmp_path / "store"))
    store.append({"a": source(spark, "1.1.1.1"), "b": source(spark, "2.2.2.2")})

    def lost(entries):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="lost"):
        patch.setattr(store, "_enter", lost)
        store.rebuild({"a": source(spark, "3.3.3.3")})
    assert sorted((r.source, r.source_ip) for r in store.events().collect()) == [("a", "1.1.1.1"), ("b", "2.2.2.2")]
    broken = source(spark, "4.4.4.4").withColumn("method", F.raise_error(F.lit("broken input")).cast("string"))
    with pytest.raises(Exception, match="broken input"):
        store.rebuild({"a": broken})
    assert store.events().count() == 2 and store.sources().count() == 2
    store.rebuild({"a": source(spark, "3.3.3.3")})
    assert [(r.source, r.source_ip) for r in store.events().collect()] == [("a", "3.3.3.3")]


def test_own_aliases_reach_the_store(spark, tmp_path):
    mine = {"source_ip": ["who"]}
    store = EventStore(spark, str(tmp_path / "store"), aliases=mine)
    store.append({"a": spark.sql("select '1.1.1.1' as who, '9.9.9.9' as client_ip")})
    assert [r.source_ip for r in store.events().collect()] == ["1.1.1.1"]
    assert replace_events(spark.sql("select 'x' as who"), str(tmp_path / "one"), mine)[0]["source_ip"] == "who"
    assert N.is_analyzable(["who"], mine) and not N.is_analyzable(["who"])


def test_folders_of_files_are_sources_by_layout(spark, tmp_path):
    folder = tmp_path / "in" / "deep er"
    folder.mkdir(parents=True)
    for i in range(40):
        (folder / f"a {i}.csv").write_text(f"client_ip,method\n1.1.1.{i},GET\n1.1.1.{i},GET\n")
        (tmp_path / "in" / f"b{i}.csv").write_text(f"status;ip;who\n404;2.2.2.{i};x\n")
    (tmp_path / "in" / "empty.csv").write_text("")
    (tmp_path / "in" / "header.csv").write_text("client_ip,method\n")
    store = EventStore(spark, str(tmp_path / "store"))
    layouts = csv_layouts(spark, str(tmp_path / "in"), store.sources())
    assert sorted(len(files) for files, _ in layouts) == [40, 41]
    events = N.normalize_layouts([df for _, df in layouts])
    assert events._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
    assert store.append_files(str(tmp_path / "in")) == 80 and store.append_files(str(tmp_path / "in")) == 0
    (tmp_path / "in" / "c.csv").write_text("time,remote_addr\n2024-01-01,3.3.3.3\n")
    assert store.append_files(str(tmp_path / "in")) == 1
    got = store.events()
    assert got.count() == 121 and got.filter("status_code = 404").count() == 40
    assert got.filter(got.source.endswith("deep er/a 7.csv")).select("source_ip").distinct().collect() == [("1.1.1.7",)]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.csv").write_text("ip\n8.8.8.8\n")
    assert store.rebuild_files(str(tmp_path / "other")) == 1 and [r.source_ip for r in store.events().collect()] == ["8.8.8.8"]


def test_union_commutes_with_normalize(spark):
    a, b = source(spark, "1.1.1.1"), source(spark, "2.2.2.2", "1.1.1.1")
    apart = N.normalize_all({"a": a, "b": b}).drop("source")
    together = N.normalize(a.unionByName(b))[0]
    assert apart.exceptAll(together).isEmpty() and together.exceptAll(apart).isEmpty()


def test_streams_take_each_file_once(spark, tmp_path):
    base = str(tmp_path)
    for n in (1, 2):
        source(spark, f"{n}.1.1.1").coalesce(1).write.mode("append").parquet(f"{base}/raw")
        for _ in range(2):
            stream_table_files(spark, f"{base}/raw", "client_ip string, method string", f"{base}/events", f"{base}/cp").awaitTermination()
        assert spark.read.parquet(f"{base}/events").count() == n
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text('10.0.0.1 - - [14/Nov/2023:12:00:00 +0000] "GET / HTTP/1.1" 200 1\n')
    stream_text_files(spark, f"{base}/logs", "web", f"{base}/web", f"{base}/cp2").awaitTermination()
    assert spark.read.parquet(f"{base}/web").head()["status_code"] == 200


def test_raw_tables_skip_system_names(spark):
    for name in ("raw_x", "events", "_logsift_sources", "allowlisted_indicators"):
        source(spark, "1.1.1.1").createOrReplaceTempView(name)
    names = raw_tables(spark)
    assert "raw_x" in names and not {"events", "_logsift_sources", "allowlisted_indicators"} & set(names)
    row = describe_tables(spark, ["raw_x"]).head()
    assert tuple(row) == ("raw_x", 1, "client_ip, method", True)


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_text_stream_detects_formats_and_repeats_nothing(spark, tmp_path, monkeypatch):
    web = '10.0.0.1 - - [14/Nov/2023:12:00:00 +0000] "GET /x HTTP/1.1" 200 1'
    raw, base = tmp_path / "raw", str(tmp_path)
    (raw / "deep").mkdir(parents=True)
    (raw / "a b.log").write_text(f"{web}\n\n{web}\n")
    (raw / "deep" / "s.log").write_text("Jan 15 08:00:00 srv-01 sshd[1234]: Failed password for alice from 10.0.0.5 port 22 ssh2\n" * 3)
    (raw / "n.log").write_text("nothing to see\n")

    def run():
        stream_detected_text(spark, str(raw), f"{base}/events", f"{base}/formats", f"{base}/cp").awaitTermination()

    def lost(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch, pytest.raises(Exception, match="lost"):
        patch.setattr(ingest, "normalize", lost)  # after the formats are stored
        run()
    run()
    run()
    # Another file for the second batch; the first one's events stay as they are.
    (raw / "c.log").write_text('{"ts":"2024-01-01T00:00:00Z","component":"api","src_ip":"1.2.3.4","status":200}\n')
    run()
    events = streamed_events(spark, f"{base}/events")
    assert events.count() == 3 + 3 + 1 and events.columns == list(EVENT_COLUMNS)
    formats = {r.file.rsplit("/", 1)[-1]: r.format for r in spark.read.parquet(f"{base}/formats").collect()}
    assert formats == {"a b.log": "web", "s.log": "syslog", "n.log": "raw", "c.log": "jsonline"}
    for name in ("a b.log", "deep", "c.log"):
        batch = N.normalize(adapters.read_text_log(spark, str(raw / name)))[0]
        assert batch.exceptAll(events).isEmpty()
