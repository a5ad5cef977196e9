import json

import pytest
from pyspark.sql import functions as F

from logsift.operators import extract
from logsift.session import materialize
from logsift.sources import adapters, files, lines, netsets, tabular


def test_csv_stays_text(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('timestamp,client_ip,status,note\n2024-01-01T00:00:00,1.2.3.4,200,"a, ""b"""\n2024-01-01T00:01:00,,404,""\n')
    df = tabular.read_csv(spark, str(path))
    assert {t for _, t in df.dtypes} == {"string"}
    assert [tuple(r) for r in df.collect()] == [
        ("2024-01-01T00:00:00", "1.2.3.4", "200", 'a, "b"'), ("2024-01-01T00:01:00", None, "404", None),
    ]
    typed = tabular.read_csv(spark, str(path), infer=True)
    assert dict(typed.dtypes)["status"] == "int" and dict(typed.dtypes)["timestamp"] == "timestamp_ntz"


def test_csv_fields_may_hold_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n1,"two\nlines"\n2,x\n')
    assert [tuple(r) for r in tabular.read_csv(spark, str(path)).collect()] == [("1", "two\nlines"), ("2", "x")]
    plain = tmp_path / "b.csv"
    plain.write_text('a,b\n1,"say ""x"""\n')
    assert tabular.has_multi_line_fields(spark, str(path)) and not tabular.has_multi_line_fields(spark, str(plain))


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_delimiter_is_sniffed(spark, tmp_path, sep):
    path = tmp_path / "a.csv"
    path.write_text(f"Timestamp{sep}Level\n2024{sep}high\n")
    assert tabular.read_csv(spark, str(path), sep=None).columns == ["Timestamp", "Level"]


def test_json_lines_and_arrays(spark, tmp_path):
    records = [{"ts": 1, "who": {"ip": "1.2.3.4"}, "tags": ["a"]}, {"ts": 2, "who": {"ip": None}, "tags": []}]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in records))
    (tmp_path / "array.json").write_text(json.dumps(records, indent=1))
    for name in ("lines.json", "array.json"):
        df = tabular.read_json(spark, str(tmp_path / name))
        assert [(r.ts, r.who.ip) for r in df.orderBy("ts").collect()] == [(1, "1.2.3.4"), (2, None)]


def test_json_keys_that_differ_by_case(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text('{"A": 1, "a": 2}\n')
    df = tabular.read_json(spark, str(path))
    assert sorted(df.columns) == ["A", "a_1"] and tuple(df.select("A", "a_1").head()) == (1, 2)


FILES = [
    ("/in/a.CSV", 10, "whatever", "csv"), ("/in/b.jsonl", 10, '  \n {"a":1}', "json"), ("/in/c", 10, "[1]", "json"),
    ("/in/d.data", 10, "x,y\n1,2", "csv"), ("/in/e.out", 10, "just text, yes", "csv"), ("/in/f", 10, ",a,b", "log"),
    ("/in/g.evtx", 10, None, "evtx"), ("/in/h.txt", 10, None, "txt"), ("/in/i.out", 10, "plain", "log"),
    ("/in.d/noext", 10, "plain", "log"), ("/in/.csv", 10, "plain", "log"),
]


def test_formats(spark):
    df = spark.createDataFrame([f[:3] for f in FILES], "path string, length long, head string")
    got = {r.path: r.format for r in files.classify_files(df).collect()}
    assert got == {f[0]: f[3] for f in FILES}
    overridden = files.classify_files(df, override="JSON").select("format").distinct().collect()
    assert overridden == [("json",)]
    with pytest.raises(ValueError):
        files.classify_files(df, override="pdf")


def test_invalid_files(spark):
    df = spark.createDataFrame(
        [("/in/empty.log", 0, None), ("/in/gone.log", None, None), ("/in/x.bin", 4, None), ("/in/ok.log", 3, "abc"), ("/in/ok.evtx", 3, None)],
        "path string, length long, head string",
    )
    got = {r.path: (r.status, r.validation_error, r.needs_conversion) for r in files.classify_files(df).collect()}
    assert got["/in/empty.log"][:2] == ("invalid", "Log file is empty: /in/empty.log")
    assert got["/in/gone.log"][0] == "invalid" and "not found" in got["/in/gone.log"][1]
    assert got["/in/x.bin"][0] == "invalid"
    assert got["/in/ok.log"] == ("ready", None, False) and got["/in/ok.evtx"][2] is True


def test_catalog_keeps_files_with_odd_names(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, content in {"b c.log": "x\ny\n", "a%20c.log": "x\ny\n", "d+é.log": "x\ny", "deep/e f": "a,b\n1,2\n", "g.log": ""}.items():
        (tmp_path / name).write_bytes(content.encode())
    got = {r.path.rsplit("/", 1)[-1]: (r.format, r.status) for r in files.catalog(spark, str(tmp_path)).collect()}
    assert got == {"a%20c.log": ("log", "ready"), "b c.log": ("log", "duplicate"), "d+é.log": ("log", "ready"), "e f": ("csv", "ready"), "g.log": (None, "invalid")}


def test_folders_of_unlike_files(spark, tmp_path):
    csv, mixed = tmp_path / "csv", tmp_path / "json"
    csv.mkdir()
    mixed.mkdir()
    (csv / "a.csv").write_text("timestamp,client_ip,status\nt1,1.2.3.4,200\n")
    (csv / "b c.csv").write_text("status;client_ip;note\n404;9.9.9.9;x\n")
    (csv / "d.csv").write_text("timestamp,client_ip,status\nt2,5.6.7.8,500\n")
    rows = {(r.timestamp, r.client_ip, r.status, r.note) for r in tabular.read_csv(spark, str(csv), sep=None).collect()}
    assert rows == {("t1", "1.2.3.4", "200", None), (None, "9.9.9.9", "404", "x"), ("t2", "5.6.7.8", "500", None)}
    (mixed / "lines.json").write_text("\n".join(json.dumps({"n": i, "v": i}) for i in range(10)))
    (mixed / "array x.json").write_text(json.dumps([{"n": 10 + i, "v": "t", "more": {"a": 1}} for i in range(5)], indent=1))
    got = sorted((r.n, r.v) for r in tabular.read_json(spark, str(mixed)).collect())
    assert got == [(i, str(i)) for i in range(10)] + [(10 + i, "t") for i in range(5)]


def test_catalog_of_real_files(spark, tmp_path):
    (tmp_path / "one.log").write_text("same\n")
    (tmp_path / "two.log").write_text("same\n")
    (tmp_path / "noext").write_text("a,b\n1,2\n")
    (tmp_path / "blob.bin").write_bytes(b"\xff\xfe\x00\x01 text\n")
    listed = files.list_files(spark, str(tmp_path))
    heads = lines.file_heads(lines.read_lines(spark, str(tmp_path))).withColumnRenamed("file", "path")
    digests = files.content_digests(spark, str(tmp_path))
    catalog = files.classify_files(listed.join(heads, "path", "left").join(digests, "path"))
    marked = files.mark_duplicates(catalog)
    got = {r.path.rsplit("/", 1)[-1]: (r.format, r.status) for r in marked.collect()}
    assert got == {"one.log": ("log", "ready"), "two.log": ("log", "duplicate"), "noext": ("csv", "ready"), "blob.bin": (None, "invalid")}
    counts = {r.status: r.n_files for r in files.status_counts(marked).collect()}
    assert counts == {"ready": 2, "pending": 0, "ingested": 0, "invalid": 1, "error": 0}


def test_content_keys_do_not_depend_on_splits(spark, tmp_path):
    text = "".join(f"line {i}\n" for i in range(5000))
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    for name, content in {"one/a.log": text, "two/b.log": text, "two/c.log": "x\n"}.items():
        (tmp_path / name).write_text(content)
    alone = {r.content_key for r in files.content_digests(spark, str(tmp_path / "one")).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert alone < {r.content_key for r in files.content_digests(spark, str(tmp_path / "two")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_are_compared_by_their_lines(spark, tmp_path):
    for name, content in {"a": "x\ny\n", "b": "x\ny\n", "c": "y\nx\n", "d": "x\r\ny", "e": "x\ny\r"}.items():
        (tmp_path / f"{name}.log").write_bytes(content.encode())
    keys = {r.path.rsplit("/", 1)[-1][0]: r.content_key for r in files.content_digests(spark, str(tmp_path)).collect()}
    assert keys["a"] == keys["b"] and len({keys[k] for k in "acde"}) == 4


def test_profile_and_preview(spark):
    df = spark.sql("select 1 as n, named_struct('x', 2) as s, array('a') as l, x'ff' as bad, cast('é' as binary) as good")
    prof = [tuple(r) for r in tabular.profile(df, "t").orderBy("ordinal").collect()]
    assert prof[0] == ("t", 1, 0, "n", "int") and len(prof) == 5
    assert tuple(tabular.preview_rows(df).head()) == (1, '{"x":2}', '["a"]', "FF", "é")
    assert tabular.preview_rows(spark.range(300)).count() == 100


def test_netsets(spark, tmp_path):
    (tmp_path / "level1.netset").write_text("# comment\n\n 10.0.0.0/8 \nnot-a-cidr\n")
    (tmp_path / "level2.netset").write_text("192.0.2.0/24\n")
    (tmp_path / "level1.meta.json").write_text('{"fetched_at": "2024-01-01T00:00:00+00:00"}')
    got = sorted(tuple(r) for r in netsets.read_netsets(spark, str(tmp_path)).collect())
    assert got == [("level1", "10.0.0.0/8"), ("level1", "not-a-cidr"), ("level2", "192.0.2.0/24")]
    expected = spark.createDataFrame([("level1",), ("level2",), ("level3",)], "list_name string")
    found = netsets.read_list_files(spark, str(tmp_path))
    fresh = netsets.list_freshness(expected, found, F.lit("2024-01-01 23:00:00").cast("timestamp"))
    state = {r.list_name: (r.loaded, r.stale) for r in fresh.collect()}
    assert state["level1"] == (True, False) and state["level3"] == (False, True)
    late = netsets.list_freshness(expected, found, F.lit("2024-01-03 00:00:00").cast("timestamp"))
    assert {r.list_name: r.stale for r in late.collect()}["level1"] is True
    unreadable = found.withColumn("fetched_at", F.lit("yesterday")).withColumn("modified", F.lit("2024-01-02 12:00:00").cast("timestamp"))
    again = netsets.list_freshness(expected, unreadable, F.lit("2024-01-03 00:00:00").cast("timestamp"))
    assert {r.list_name: r.stale for r in again.collect()} == {"level1": False, "level2": False, "level3": True}


def test_refresh_summary(spark):
    log = spark.createDataFrame([("a", "updated"), ("b", "unchanged"), ("c", "cached"), ("d", "error: HTTP 500")], "list_name string, status string")
    got = {r.outcome: r.n_results for r in netsets.refresh_summary(log).collect()}
    assert got == {"updated": 2, "cached": 1, "error": 1}


def test_csv_rows_with_more_fields_than_the_header_fail(spark, tmp_path):
    (tmp_path / "few.csv").write_text('id,message\n1,"a,b"\n2\n3,"x\ny"\n4,\n')
    for extra in ("5,one,two", "5,one,,two", '5,"a,b",c', '5,"x\ny",c'):
        path = tmp_path / f"{abs(hash(extra))}.csv"
        path.write_text("id,message\n1,a\n" + extra + "\n")
        for sep, infer in ((",", False), (None, False), (None, True)):
            df = tabular.read_csv(spark, str(path), sep, infer)
            for action in (df.collect, df.count, df.select("id").collect):
                with pytest.raises(Exception, match="more fields than its header"):
                    action()
    got = tabular.read_csv(spark, str(tmp_path / "few.csv"), infer=True)
    assert got.columns == ["id", "message"] and got.count() == 4
    assert [tuple(r) for r in got.collect()] == [(1, "a,b"), (2, None), (3, "x\ny"), (4, None)]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_heads_of_files_with_several_splits(spark, tmp_path, small_splits, monkeypatch):
    texts = {
        "long first": ["x" * 30_000, *[f"line {i}" for i in range(6000)]],
        "plain": [f"{i} " + "y" * (i % 50) for i in range(9000)],
        "short": ["a", "", "b"],
        "one line": ["z" * 20_000],
    }
    for name, rows in texts.items():
        (tmp_path / f"{name}.log").write_text("\n".join(rows) + "\n")
    written = []
    monkeypatch.setattr(lines, "materialize", lambda df, label: written.append(df.columns) or materialize(df, label))
    read = lines.read_lines(spark, str(tmp_path))
    assert read.select("file", "block").distinct().count() > 30
    for n in (1, 2, 20, 5000):
        got = {}
        for r in lines.numbered_head(read, n).collect():
            got.setdefault(r.file.rsplit("/", 1)[-1][:-4], {})[r.line_no] = r.line
        assert got == {name: {i + 1: t or None for i, t in enumerate(rows[:n])} for name, rows in texts.items()}
    # What is written are places of splits, never lines.
    assert written and all("line" not in columns for columns in written)
    assert lines.head_lines(read, 5000).count() == sum(min(5000, len(t)) for t in texts.values())
    cut = {(r.file.rsplit("/", 1)[-1], r.line_no): r.line for r in lines.preview(read, 3, 100).collect()}
    assert cut["long first.log", 1] == "x" * 100 and cut["short.log", 3] == "b" and ("one line.log", 2) not in cut


def test_format_found_behind_a_long_first_split(spark, tmp_path, small_splits):
    web = '10.0.0.1 - - [14/Nov/2023:12:00:00 +0000] "GET /x HTTP/1.1" 200 1'
    (tmp_path / "late.log").write_text("n" * 20_000 + "\n" + web + "\n")
    (tmp_path / "too late.log").write_text("n" * 20_000 + "\n" + "n\n" * 19 + web + "\n")
    (tmp_path / "first.log").write_text(web + "\n" + "n" * 20_000 + "\n")
    out = extract.detect_formats(lines.read_lines(spark, str(tmp_path)))
    got = {r.file.rsplit("/", 1)[-1]: (r.format, r.head_hit) for r in out.collect()}
    assert got == {"late.log": ("web", True), "too late.log": ("ambiguous", False), "first.log": ("web", True)}
    df = adapters.read_text_log(spark, str(tmp_path))
    assert df.filter("source_ip = '10.0.0.1'").count() == 2 and df.count() == 25


def test_catalog_reads_the_files_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_text("[1]\n")
    (tmp_path / "b.log").write_text("x\n")
    plan = plan_of(files.file_digests(spark, str(tmp_path)))
    # The one sort is that of a file's few splits, inside an array; there is none of lines.
    assert plan.count("FileScan text") == 1 and "Window" not in plan and "BatchScan" not in plan and "+- Sort " not in plan.split("Exchange")[-1]
    monkeypatch.setattr(files, "file_heads", None)  # not called where the heads are settled
    got = {r.path.rsplit("/", 1)[-1]: r.format for r in files.catalog(spark, str(tmp_path)).collect()}
    assert got == {"a": "json", "b.log": "log"}


def test_catalog_where_the_end_of_the_head_matters(spark, tmp_path):
    broken = b"\xff\xfe\n"
    contents = {
        "good first, broken soon": b"text\n" + broken, "good first, broken late": b"text\n" * 2000 + broken, "broken first": broken + b"text\n",
        "few blanks": b"\n  \n\t\n{}\n", "many blanks": b"\n" * 5000 + b"{}\n", "comma behind blanks": b"\n" * 4000 + b"a" * 90 + b"," + b"a\n",
        "comma too far": b"\n" * 4000 + b"a" * 200 + b",\n", "all blank": b" \n\n", "long line": b"a" * 9000 + b",\n", "early comma": b"a," + b"a" * 9000, "mark": b"\x1c\n{}\n",
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[-1]: (r.format, r.status) for r in files.catalog(spark, str(tmp_path)).collect()}
    want = {}
    for name, content in contents.items():
        try:
            text = content[:4096].decode()
        except UnicodeDecodeError:
            text = ""
        text = text.lstrip(" \t\n\x0b\x0c\r")
        first = text.splitlines()[0] if text else ""
        kind = None if not first else "json" if first[0] in "{[" else "csv" if "," in first and first[0].isalnum() else "log"
        want[name] = (kind, "ready" if kind else "invalid")
    assert got == want


def test_digests_depend_on_order_and_every_line(spark, tmp_path, small_splits):
    rows = [f"row {i % 700}" for i in range(4000)]
    swapped = rows[:]
    swapped[10], swapped[3500] = swapped[3500], swapped[10]
    moved = rows[1000:] + rows[:1000]
    contents = {"a": rows, "b": rows, "swapped": swapped, "moved": moved, "blank first": ["", *rows[:-1]], "blank last": [*rows[:-1], ""]}
    for name, content in contents.items():
        (tmp_path / name).write_text("\n".join(content) + "\n")
    keys = {r.path.rsplit("/", 1)[-1]: r.content_key for r in files.content_digests(spark, str(tmp_path)).collect()}
    assert keys["a"] == keys["b"] and len(set(keys.values())) == len(keys) - 1


def test_power(spark):
    exponents = [0, 1, 2, 63, 64, 4097, 2**33 - 1, 2**35 + 12345]
    got = spark.createDataFrame([(e,) for e in exponents], "e long").select(files._power(F.col("e"), files.ROOT)).collect()
    assert [r[0] for r in got] == [pow(files.ROOT, e, files.PRIME) for e in exponents]
