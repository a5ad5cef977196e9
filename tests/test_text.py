import pytest
from pyspark.sql import functions as F

from logsift.operators import extract
from logsift.operators.normalize import normalize
from logsift.sources import adapters, lines

WEB = [
    '10.0.0.1 - - [14/Nov/2023:12:00:00 +0000] "GET /index.html HTTP/1.1" 200 1024',
    '10.0.0.2 - - [14/Nov/2023:14:00:00 +0200] "POST /login HTTP/1.1" 401 12',
]
SYSLOG = [
    "Jan 15 08:00:00 srv-01 sshd[1234]: Failed password for alice from 10.0.0.5 port 22 ssh2",
    "Jan 15 08:00:01 srv-01 systemd[1]: Started Session 12 of user bob.",
]
JSON_LINES = [
    '{"ts":"2024-01-01T00:00:00Z","component":"api","src_ip":"1.2.3.4","status":200,"duration_ms":10}',
    '{"time": "23/Sep/2021:04:15:09 +0000", "remote_ip": "198.51.100.7", "request": "GET /media/clip.ogg HTTP/1.1", "response": 304}',
    '{"timestamp": 1431433200, "server_zones": {"hg": 1}}',
]
UNCLEAR = ["[00:00:07] pulse-lost OK code=12 len=300", "[00:00:08] pulse OK code=13 len=200"]


def frame(spark, texts, file="f"):
    return spark.createDataFrame([(file, 0, i, t) for i, t in enumerate(texts)], "file string, block long, pos long, line string")


def fields(df):
    return [(r.event_timestamp, r.source_ip, r.status_code, r.event_type) for r in df.orderBy("pos").collect()]


def test_web_fields(spark):
    assert fields(extract.extract(frame(spark, WEB), "web")) == [
        ("14/Nov/2023:12:00:00 +0000", "10.0.0.1", "200", "GET"),
        ("14/Nov/2023:14:00:00 +0200", "10.0.0.2", "401", "POST"),
    ]


def test_syslog_fields(spark):
    assert fields(extract.extract(frame(spark, SYSLOG), "syslog")) == [
        ("Jan 15 08:00:00", "10.0.0.5", None, "sshd"),
        ("Jan 15 08:00:01", "", None, "systemd"),
    ]


def test_json_fields(spark):
    assert fields(extract.extract(frame(spark, JSON_LINES), "jsonline")) == [
        ("2024-01-01T00:00:00Z", "1.2.3.4", "200", "api"),
        ("23/Sep/2021:04:15:09 +0000", "198.51.100.7", "304", "GET"),
        ("1431433200", "", "", ""),
    ]


@pytest.mark.parametrize(("texts", "want"), [
    (WEB, "web"), (SYSLOG, "syslog"), (JSON_LINES, "jsonline"), (UNCLEAR, "ambiguous"),
    (["x"] * 20 + WEB, "ambiguous"), (["x"] * 19 + SYSLOG, "syslog"), ([None, *WEB], "web"),
])
def test_detect(spark, texts, want):
    assert extract.detect_formats(frame(spark, texts)).head()["format"] == want


def test_web_lines_normalize_to_utc(spark):
    events, mapping = normalize(extract.extract(frame(spark, WEB), "web").drop("file", "block", "pos"))
    got = [(str(r.event_timestamp), r.status_code, r.raw_message) for r in events.collect()]
    assert got == [("2023-11-14 12:00:00", 200, WEB[0]), ("2023-11-14 12:00:00", 401, WEB[1])]
    assert mapping["status_code"] == "status_code"


def test_mixed_files_keep_their_own_format(spark):
    empty = ['{"time": null, "note": "nothing"}'] * 3
    late = ['{"time": null}'] * 25 + JSON_LINES[:1]
    parts = {"w": WEB, "s": SYSLOG, "j": JSON_LINES, "u": UNCLEAR, "e": empty, "l": late}
    mixed = None
    for name, texts in parts.items():
        part = frame(spark, texts, name)
        mixed = part if mixed is None else mixed.unionByName(part)
    out = extract.structured_lines(mixed)
    formats = {r["file"]: (r["format"], r["structured"]) for r in out.select("file", "format", "structured").distinct().collect()}
    assert formats == {
        "w": ("web", True), "s": ("syslog", True), "j": ("jsonline", True), "u": ("raw", False), "e": ("raw", False), "l": ("jsonline", True),
    }
    assert out.count() == sum(len(t) for t in parts.values())
    assert out.filter("file = 'e'").select("event_timestamp").distinct().collect() == [(None,)]
    # Capped before the only hit, the late file is raw.
    capped = extract.structured_lines(mixed, max_lines=10).filter("file = 'l'")
    assert capped.count() == 10 and capped.filter("structured").count() == 0


def test_head_lines_across_blocks(spark):
    data = [("a", block, pos, f"a{block}-{pos}") for block in (0, 100, 200) for pos in range(7)]
    data += [("b", 0, 0, "b0")]
    df = spark.createDataFrame(data, "file string, block long, pos long, line string").repartition(5)
    for n in (1, 7, 8, 15, 100):
        got = {(r.file, r.line) for r in lines.head_lines(df, n).collect()}
        want = {(f, t) for f in "ab" for t in [d[3] for d in data if d[0] == f][:n]}
        assert got == want
    assert lines.head_lines(df, 0).count() == len(data)


def test_text_file_is_verbatim_and_capped(spark, tmp_path):
    path = tmp_path / "app.log"
    texts = ['a,b "quoted" \\"x\\"', "", "plain"] + [f"line {i}" for i in range(10)]
    path.write_text("\n".join(texts) + "\n")
    read = lines.read_lines(spark, str(path)).orderBy("block", "pos")
    assert [r.line for r in read.collect()] == [t or None for t in texts]
    capped = adapters.read_text_log(spark, str(path), max_lines=3, structured=False)
    assert capped.columns == ["line"] and [r.line for r in capped.collect()] == [texts[0], None, "plain"]


def test_structured_text_file_and_dispatch(spark, tmp_path):
    (tmp_path / "access.log").write_text("\n".join(WEB) + "\n")
    df = adapters.read_source(spark, str(tmp_path / "access.log"), "log")
    assert df.columns == ["event_timestamp", "source_ip", "status_code", "event_type", "raw_message"]
    (tmp_path / "beat.log").write_text("\n".join(UNCLEAR) + "\n")
    assert adapters.read_source(spark, str(tmp_path / "beat.log"), "txt").columns == ["line"]
    with pytest.raises(ValueError):
        adapters.read_source(spark, "x", "pdf")
    with pytest.raises(ValueError):
        adapters.read_source(spark, "x", "evtx", "unknown-tool")


def test_preview_limits_lines_and_bytes(spark):
    texts = ["é" * 10, "b" * 30, "c" * 30]
    got = [(r.line_no, r.line) for r in lines.preview(frame(spark, texts), 2, 100).orderBy("line_no").collect()]
    assert got == [(1, texts[0]), (2, texts[1])]
    cut = [r.line for r in lines.preview(frame(spark, texts), 10, 40).orderBy("line_no").collect()]
    assert cut == [texts[0], "b" * 19]


def test_field_profile(spark):
    row = extract.field_profile(frame(spark, UNCLEAR), "ambiguous").head()
    assert (row.n_lines, row.timestamp, row.source_ip, row.status_code, row.event_type) == (2, 2, 0, 2, 0)


def test_hit_counts(spark):
    extracted = extract.extract(frame(spark, [*WEB, "noise", None]), "web")
    row = extract.hit_counts(extracted, ["file"]).head()
    assert (row.hits, row.n_lines) == (2, 4)
    assert extracted.filter(F.col("raw_message").isNull()).head()["source_ip"] is None
