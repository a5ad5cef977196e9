import json

import pytest
from pyspark.sql import functions as F

from logsift import constants as C
from logsift.operators import enrich, records, reports
from logsift.plans.hybrid import ingest_records, correlation_view_name, has_correlation, load_hybrid
from logsift.plans.shapes import fill_cores
from logsift.sources import adapters

EVENT = {"Event": {
    "System": {
        "Provider": {"#attributes": {"Name": "Audit", "@Guid": "{1}"}}, "EventID": {"#text": 4624, "#attributes": {"Qualifiers": ""}},
        "Version": 2, "Level": 0, "Task": 12544, "TimeCreated": {"#attributes": {"SystemTime": "2024-01-01T00:00:00Z"}},
        "Channel": "Security", "Computer": "HOST.example.com",
    },
    "EventData": {"Data": [
        {"#attributes": {"Name": "IpAddress"}, "#text": "1.2.3.4"}, {"#attributes": {"Name": "StatusCode"}, "#text": 0},
        {"#attributes": {"Name": "Note"}, "#text": "first"}, {"#attributes": {"Name": "Note"}, "#text": "läst \"q\""},
    ]},
}}
SCHEMA = "event_record_id long, timestamp string, data string"


def record_frame(spark, *payloads):
    data = [(i + 1, "2024-01-01 00:00:00", p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(data, SCHEMA)


def test_record_row(spark):
    row = records.record_rows(record_frame(spark, EVENT)).head()
    assert tuple(row.__fields__) == C.RECORD_COLUMNS
    assert (row.timestamp, row.event, row.record_id, row.source_ip, row.status_code) == ("2024-01-01T00:00:00Z", "4624", "1", "1.2.3.4", "0")
    assert (row.provider, row.channel, row.computer, row.level, row.task) == ("Audit", "Security", "HOST.example.com", "0", "12544")
    want = {
        "EventData_Data_IpAddress": "1.2.3.4", "EventData_Data_Note": 'läst "q"', "EventData_Data_StatusCode": 0,
        "System_Channel": "Security", "System_Computer": "HOST.example.com", "System_EventID": 4624, "System_EventID_Qualifiers": "",
        "System_Level": 0, "System_Provider_Guid": "{1}", "System_Provider_Name": "Audit", "System_Task": 12544,
        "System_TimeCreated_SystemTime": "2024-01-01T00:00:00Z", "System_Version": 2,
    }
    assert row.message == json.dumps(want, ensure_ascii=False, sort_keys=True)


def test_plain_lists_and_missing_parts(spark):
    first = {"UserData": {"Ports": [22, 8080], "Half": [{"#attributes": {"Name": "n"}, "#text": 5}, "z"], "Nothing": [], "Void": {}, "Flag": True}}
    df = records.record_rows(record_frame(
        spark, {"Event": first}, None, {"Event": {"StatusCode": "", "Status": 7, "IpAddress": None, "SourceIp": "9.9.9.9", "#text": "t"}},
    ))
    first, second = df.orderBy("record_id").collect()
    assert first.message == (
        '{"UserData_Flag": true, "UserData_Half": [{"#attributes": {"Name": "n"}, "#text": 5}, "z"], "UserData_Nothing": [], "UserData_Ports": [22, 8080]}')
    assert first.timestamp == "2024-01-01 00:00:00" and first.channel is None
    assert (second.record_id, second.status_code, second.source_ip) == ("3", "7", "9.9.9.9")
    assert json.loads(second.message)["#text"] == "t"


def test_the_last_of_equal_keys_in_the_document_counts(spark):
    payloads = [
        '{"b_c": 1, "b": {"c": 2}}', '{"b": {"c": 2}, "b_c": 1}', '{"a": {"x": 1}, "z": 0, "a": {"y": 2}}', '{"p": {"Id": 3, "#attributes": {"Id": 4}, "#text": 5}}',
        '{"l": [{"#attributes": {"Name": "n"}, "#text": 1}, {"#text": 2, "#attributes": {"@x": 0, "Name": "n"}}], "l_n": 3}',
    ]
    frame = record_frame(spark, *[f'{{"Event": {p}}}' for p in payloads])
    got = {r.record_id: json.loads(r.message) for r in records.record_rows(frame).collect()}
    assert got == {"1": {"b_c": 2}, "2": {"b_c": 1}, "3": {"a_y": 2, "z": 0}, "4": {"p": 5, "p_Id": 3}, "5": {"l_n": 3}}


def test_numbers_and_texts_keep_their_form(spark):
    values = '{"whole": 1, "part": 1.0, "large": 1e+22, "small": 1E-7, "long": 12345678901234567890123, "zeros": 2.500, "minus": -0.0, "same": "1.0"}'
    texts = r'{"letters": "\u00e9\u4e16", "control": "\u001f\n", "half": "\ud800", "list": [1.50, {"z": 1, "a": [null, "x", false]}]}'
    frame = record_frame(spark, f'{{"Event": {values}}}', f'{{"Event": {texts}}}')
    one, two = [r.message for r in records.record_rows(frame).orderBy("record_id").collect()]
    assert one == (
        '{"large": 1e+22, "long": 12345678901234567890123, "minus": -0.0, "part": 1.0, "same": "1.0", "small": 1e-07, "whole": 1, "zeros": 2.5}')
    assert two == '{"control": "\\u001f\\n", "half": "?", "letters": "\u00e9\u4e16", "list": [1.5, {"a": [null, "x", false], "z": 1}]}'
    leaves = records.flatten_payload(frame, "data", "flat", element="Event").select("flat").head()["flat"]
    assert (leaves["part"].text, leaves["part"].json, leaves["same"].text, leaves["same"].json) == ("1.0", "1.0", "1.0", '"1.0"')


def test_broken_records(spark):
    df = record_frame(spark, EVENT, "{not json", {"Other": 1}, None)
    with pytest.raises(Exception, match="Unable to parse event record 2"):
        records.record_rows(df.filter("event_record_id = 2")).collect()
    good, broken = records.split_records(df)
    assert [r.event_record_id for r in good.collect()] == [1] and sorted(r.event_record_id for r in broken.collect()) == [2, 3]
    assert records.record_rows(df.limit(0)).count() == 0


def test_records_of_any_depth(spark, tmp_path):
    def flat(value, parent=""):
        out = {}
        for key, inner in value.items():
            name = f"{parent}_{key}" if parent else key
            out.update(flat(inner, name) if isinstance(inner, dict) else {name: inner})
        return out

    payloads = []
    for levels in (5, 9, 40, 400):
        deep = {"Computer": "H", "odd": '\\"}]{ "', "list": [[["x"]]]}
        for i in range(levels - 1):
            deep = {f"l{i}": deep, "side": i, "text": '"}}}'}
        payloads.append(deep)
    frame = record_frame(spark, *[{"Event": p} for p in payloads])
    rows = records.record_rows(frame).collect()
    assert {r.record_id: json.loads(r.message) for r in rows} == {str(i + 1): flat(p) for i, p in enumerate(payloads)}
    frame.write.json(str(tmp_path / "records.json"))
    assert sorted(adapters.read_records(spark, str(tmp_path / "records.json")).collect()) == sorted(rows)
    deep = {"Event": {"System": {"Channel": "Security"}, "a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": 1}}}}}}}}}
    assert records.record_preview(record_frame(spark, deep), 1).head().channel == "Security"


def test_record_preview(spark):
    shown = records.record_preview(record_frame(spark, EVENT, "{not json"), 2).orderBy("record_id").collect()
    assert [r.line for r in shown] == [
        "#1 | 2024-01-01T00:00:00Z | EventID=4624 | Audit | Security", "#2 | None | EventID=None | None | None",
    ]
    assert records.record_preview(record_frame(spark, EVENT, EVENT), 1).count() == 1
    by_identifier = record_frame(spark, EVENT, EVENT).withColumnRenamed("event_record_id", "identifier")
    assert [r.record_id for r in records.record_preview(by_identifier, 1).collect()] == ["1"]


def test_unreadable_lines_fail(spark, tmp_path):
    good = json.dumps({"event_record_id": 1, "timestamp": "t", "data": json.dumps(EVENT)})
    (tmp_path / "records.json").write_text(good + "\n" + good[:40] + "\n")
    with pytest.raises(Exception, match="Unable to parse event record"):
        adapters.read_records(spark, str(tmp_path / "records.json")).collect()


def test_hybrid_load(spark, tmp_path):
    (tmp_path / "records.json").write_text(json.dumps({"event_record_id": 1, "timestamp": "t", "data": json.dumps(EVENT)}) + "\n")
    alert = {"Timestamp": "2024-01-01T00:00:00Z", "Computer": "HOST.example.com", "Channel": "Security", "RecordID": 1, "AlertName": "Logon"}
    (tmp_path / "alerts.json").write_text("\n".join(json.dumps(a) for a in (alert, {**alert, "RecordID": 2}, {**alert, "RecordID": None})) + "\n")
    raw = adapters.read_source(spark, str(tmp_path / "records.json"), "evtx")
    alerts = adapters.read_source(spark, str(tmp_path / "alerts.json"), "evtx", "alerts-json")
    assert not has_correlation(spark, "case 7")
    tables = load_hybrid("case 7", raw, alerts)
    got = sorted(((r.RecordID, r.raw_source_ip, r.raw_task) for r in tables.correlated.collect()), key=repr)
    assert got == [(1, "1.2.3.4", "12544"), (2, None, None), (None, None, None)]
    assert has_correlation(spark, "case 7") and spark.table(correlation_view_name("case 7")).count() == 3
    assert spark.table("case_7_raw").count() == 1
    assert load_hybrid("case 8", raw).correlated is None
    assert load_hybrid("case 9", raw, spark.sql("select 1 as other")).correlated is None
    with pytest.raises(ValueError):
        load_hybrid("case 10", None, alerts)


REPORT = {
    "title": "T", "summary": "S", "severity": "High",
    "timeline": [{"time": "t0", "description": "d", "status_code": 404, "event_count": 3}, "noise", {"timestamp": "t1", "time": "t2"}],
    "mitre_mappings": [{"technique": "T1110", "name": "Brute Force", "tactic": "Credential Access"}, {}],
    "mitigation": {"format": "Sigma", "title": "m", "content": "rule", "more": 1},
    "indicators": [{"evidence": {"n": 1}}, {"type": "x", "severity": "Low", "description": "y", "threat_lists": ["l"]}],
    "metadata": {"model": "m"}, "unknown": [1],
}


def parsed(spark, *texts):
    return reports.parse_responses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"))


def test_responses(spark):
    body = json.dumps(REPORT)
    got = parsed(spark, body, f"Sure:\n```json\n{body}\n```\nbye", f"```\n{body}```", "no json", '{"title": "T"}', "[1]").orderBy("id").collect()
    assert [r.status for r in got[:4]] == ["ok", "ok", "ok", "invalid_json"]
    assert got[4].status == "missing: mitigation, mitre_mappings, severity, summary, timeline" and got[5].status == "invalid_json"
    assert got[1].report_json == body and got[3].report_json is None


def test_report_normal_form(spark):
    df = reports.normalize_reports(spark.createDataFrame([(json.dumps(REPORT),)], "report_json string"))
    report = df.head()["report"].asDict(recursive=True)
    assert [t["timestamp"] for t in report["timeline"]] == ["t0", "t1"] and report["timeline"][0]["status_code"] == 404
    assert report["mitre_mappings"] == [
        {"technique_id": "T1110", "technique_name": "Brute Force", "tactic": "Credential Access", "description": "Brute Force"},
        {"technique_id": "unknown", "technique_name": "", "tactic": "", "description": ""},
    ]
    assert report["mitigation"] == {"format": "Sigma", "title": "m", "content": "rule"}
    assert [(i["type"], i["severity"], i["evidence"], i["threat_lists"]) for i in report["indicators"]] == [
        ("unknown", "Medium", '{"n":1}', []), ("x", "Low", "{}", ["l"]),
    ]
    assert json.loads(report["metadata"]) == {"model": "m"}
    assert reports.mitre_table(df).count() == 2


def test_unreadable_reports(spark):
    bad = [
        json.dumps({**REPORT, "severity": "Severe"}), json.dumps({k: v for k, v in REPORT.items() if k != "title"}), "{oops",
        json.dumps({**REPORT, "indicators": [{"severity": "Odd"}]}), None,
    ]
    df = reports.normalize_reports(spark.createDataFrame([(b,) for b in bad], "report_json string"))
    assert [(r.readable, r.report) for r in df.collect()] == [(False, None)] * 5
    minimal = json.dumps({"title": "t", "summary": "s", "severity": "Low"})
    row = reports.normalize_reports(spark.createDataFrame([(minimal,)], "report_json string")).head()["report"]
    assert row.timeline == [] and row.mitigation.format == "" and row.metadata == "{}"


def store(spark):
    good = json.dumps(REPORT)
    data = [("r1", "2024-01-01 00:00:00", good, "a"), ("r2", "2024-01-03 00:00:00", good, None), ("r3", "2024-01-02 00:00:00", "{", "a"), ("r4", "2024-01-04 00:00:00", good, "b")]
    df = spark.createDataFrame(data, "report_id string, created_at string, report_json string, source_table string")
    return df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def test_report_store(spark, tmp_path):
    df = store(spark)
    assert [r.report_id for r in reports.list_reports(df).collect()] == ["r4", "r2", "r1"]
    assert [r.report_id for r in reports.list_reports(df, "a").collect()] == ["r2", "r1"]
    assert reports.corrupt_count(df, "a").head()[0] == 1 and reports.corrupt_count(df, "b").head()[0] == 0
    assert reports.get_report(df, "r1").head()["report"].title == "T"
    with pytest.raises(Exception, match="Report not found: nope"):
        reports.get_report(df, "nope").collect()
    new = reports.new_reports(df.select("report_json"), F.lit("2024-02-02 00:00:00"), "a")
    assert new.columns == ["report_id", "created_at", "report_json", "source_table"] and new.select("report_id").distinct().count() == 2
    old = df.drop("source_table")
    assert reports.migrate_store(old).filter("source_table is null").count() == 4
    assert reports.migrate_store(old, df).count() == 8


def test_exports(spark, tmp_path):
    listed = reports.list_reports(store(spark))
    rules = reports.rule_exports(listed, "SIGMA")
    assert {(r.extension, r.content, r.error) for r in rules.collect()} == {("yml", "rule", None)}
    wrong = reports.rule_exports(listed, "yara").head()
    assert wrong.content is None and "does not match report mitigation format 'Sigma'" in wrong.error
    reports.write_rules(rules, str(tmp_path / "rules"))
    assert spark.read.text(str(tmp_path / "rules")).filter("extension = 'yml' and report_id = 'r4'").head()["value"] == "rule"
    reports.write_reports(listed, str(tmp_path / "out"))
    exported = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(exported) == 3 and exported[0]["mitigation"]["format"] == "Sigma"


def test_rules_are_written_by_many_tasks(spark, tmp_path):
    rows = [(f"r{i}", "yml", f"rule {i}", None) for i in range(40)] + [("other", "yar", None, "no match")]
    exports = spark.createDataFrame(rows, "report_id string, extension string, content string, error string").coalesce(1)
    path = tmp_path / "rules"
    reports.write_rules(exports, str(path))
    reports.write_rules(exports.filter("report_id = 'r3'").withColumn("content", F.lit("new")), str(path))
    files = list(path.glob("extension=yml/report_id=*/part-*.txt"))
    assert len(files) == 40 and len({f.name[:10] for f in files}) > 4
    got = {r.report_id: r.value for r in spark.read.text(str(path)).collect()}
    assert got == {f"r{i}": "new" if i == 3 else f"rule {i}" for i in range(40)}


def test_rules_reach_their_folders_by_tasks(spark, tmp_path, monkeypatch):
    odd = ["plain", "a b", "50%", "x/y:z=1", "é+", "q'\"#", "tab\there", "-"]
    rows = [(name, "yml", f"rule {name}\nof two lines", None) for name in odd] + [("bare", "yar", None, None), (None, "yml", "of none", None), ("", "yml", "of nothing", None)]
    exports = spark.createDataFrame(rows, "report_id string, extension string, content string, error string")
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    with monkeypatch.context() as patch:
        patch.setattr(reports.listing, "reach", lambda *_: None)
        reports.write_rules(exports, theirs)
        want = sorted(map(tuple, reports.read_rules(spark, theirs).collect()), key=str)
    # Neither Spark's committer, which renames each folder on the driver, nor its readers see a report.
    for kind, name in ((type(exports.write), "text"), (type(spark.read), "text")):
        real = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, path, *args, real=real, **more: real(self, path, *args, **more) if path != ours else pytest.fail("the driver takes part"))
    reports.write_rules(exports, ours)
    got = sorted(map(tuple, reports.read_rules(spark, ours).collect()), key=str)
    # The two without a name share a folder, in one file or in two.
    assert [r for r in got if r[2]] == [r for r in want if r[2]] and len([r for r in got if r[2]]) == 9
    for found in (got, want):
        assert sorted("".join(r[0] for r in found if not r[2]).split("\n")) == ["", "of none", "of nothing"]
    folders = [sorted(str(f.relative_to(tmp_path / top)) for f in (tmp_path / top).glob("*/*")) for top in ("ours", "theirs")]
    assert folders[0] == folders[1] and not list((tmp_path / "ours").glob(".*"))


def test_rules_stay_when_writing_fails(spark, tmp_path):
    exports = spark.createDataFrame([(f"r{i}", "yml", "old", None) for i in range(9)], "report_id string, extension string, content string, error string")
    path = str(tmp_path / "rules")
    reports.write_rules(exports, path)
    with pytest.raises(Exception, match="broken rule"):
        reports.write_rules(exports.withColumn("content", F.when(F.col("report_id") == "r5", F.raise_error(F.lit("broken rule")).cast("string")).otherwise("new")), path)
    assert {r.value for r in reports.read_rules(spark, path).collect()} == {"old\n"} and not list((tmp_path / "rules").glob(".*"))


def test_report_context(spark):
    found = spark.createDataFrame([("i", 2, "Low", "b", "second", "{}"), ("i", 1, "High", "a", "first", "x" * 600)],
                                  "incident string, position int, severity string, type string, description string, evidence string")
    known = spark.createDataFrame([("i", "1.2.3.4", 90, 12)], "incident string, ip string, abuse_confidence_score int, total_reports int")
    samples = spark.createDataFrame([("i", n, f'{{"n":{n}}}') for n in range(15)], "incident string, position int, event string")
    text = reports.report_context(found, known, samples, header=("Head",)).head()["context"]
    parts = text.split("\n\n")
    assert parts[:4] == ["Head", "Indicators:", "- [High] a: first", "  Evidence: " + "x" * 499 + "…"]
    assert parts[4:8] == ["- [Low] b: second", "  Evidence: {}", "Threat intelligence:", "- 1.2.3.4: abuse confidence 90, reports 12"]
    assert parts[8] == "Sample raw events:" and parts[9:] == [f'{{"n":{n}}}' for n in range(10)]
    assert reports.report_context(found).head()["context"].endswith("{}")


def test_reputation(spark):
    payloads = [("1.1.1.1", '{"data":{"abuseConfidenceScore":90,"countryCode":"","isp":"x","totalReports":3}}'), ("2.2.2.2", '{"data":{"abuseConfidenceScore":null}}'), ("3.3.3.3", "oops")]
    known = enrich.ip_reputation(spark.createDataFrame(payloads, "ip string, payload string"))
    rows = {r.ip: tuple(r)[1:] for r in known.collect()}
    assert rows["1.1.1.1"] == (90, None, "x", None, 3, None) and rows["2.2.2.2"] == rows["3.3.3.3"] == (0, None, None, None, 0, None)
    ips = spark.createDataFrame([("1.1.1.1",), ("1.1.1.1",), ("9.9.9.9",), ("",), (None,)], "source_ip string")
    assert {r.ip: r.abuse_confidence_score for r in enrich.lookup_ips(ips, known).collect()} == {"1.1.1.1": 90, "9.9.9.9": 0}
    scans = [("h1", '{"last_analysis_stats":{"malicious":3,"harmless":5,"timeout":1,"confirmed-timeout":1}}'), ("h2", "{}")]
    found = enrich.hash_reputation(spark.createDataFrame(scans, "hash string, payload string"))
    assert {r.hash: (r.malicious, r.detection_ratio) for r in found.collect()} == {"h1": (3, 0.3), "h2": (0, 0.0)}
    hashes = spark.createDataFrame([("h1",), ("h3",)], "hash string")
    assert {r.hash: r.detection_ratio for r in enrich.lookup_hashes(hashes, found).collect()} == {"h1": 0.3, "h3": 0.0}


def test_context_keeps_indicators_with_missing_parts(spark):
    rows = spark.createDataFrame(
        [("i", 1, None, "top_talkers", "many", "e"), ("i", 2, "High", None, None, None)],
        "incident string, position int, severity string, type string, description string, evidence string")
    reputation = spark.createDataFrame([("i", "1.1.1.1", None, 3), ("i", "2.2.2.2", 7, None)], "incident string, ip string, abuse_confidence_score int, total_reports int")
    text = reports.report_context(rows, reputation).head()["context"]
    for line in ("- [None] top_talkers: many", "- [High] None: None", "- 1.1.1.1: abuse confidence None, reports 3", "- 2.2.2.2: abuse confidence 7, reports None"):
        assert line in text


def test_saving_reports_again(spark, tmp_path):
    path = str(tmp_path / "reports")
    texts = spark.createDataFrame([('{"title": "a"}',), ('{"title": "a"}',), ('{"title": "b"}',)], "report_json string")
    first = reports.new_reports(texts, F.lit("2024-02-02 00:00:00"), "t")
    assert reports.save_reports(spark, path, first).count() == 2
    assert reports.save_reports(spark, path, first).count() == 2
    later = reports.new_reports(texts, F.lit("2024-02-03 00:00:00"), "t")
    table = reports.save_reports(spark, path, later)
    assert table.count() == 4 and table.select("report_id").distinct().count() == 4
    assert reports.save_reports(spark, path, reports.new_reports(texts, F.lit("2024-02-02 00:00:00"))).count() == 6


def test_exporting_one_rule(spark, tmp_path):
    df = store(spark)
    reports.export_rule(df, "r1", "SIGMA", str(tmp_path / "rule"))
    assert [r.value for r in spark.read.text(str(tmp_path / "rule")).collect()] == ["rule"]
    with pytest.raises(Exception, match="does not match report mitigation format 'Sigma'"):
        reports.export_rule(df, "r1", "yara", str(tmp_path / "other"))
    with pytest.raises(Exception, match="Report not found: nope"):
        reports.export_rule(df, "nope", "sigma", str(tmp_path / "none"))


def test_alerts_that_fail_do_not_stop_the_load(spark, tmp_path):
    (tmp_path / "records.json").write_text(json.dumps({"event_record_id": 1, "timestamp": "t", "data": json.dumps(EVENT)}) + "\n")
    alert = {"Timestamp": "2024-01-01T00:00:00Z", "Computer": "HOST.example.com", "Channel": "Security", "RecordID": 1, "AlertName": "Logon"}
    (tmp_path / "alerts.json").write_text(json.dumps(alert) + "\n")
    records_path, alerts_path = str(tmp_path / "records.json"), str(tmp_path / "alerts.json")
    tables = ingest_records(spark, "case 20", records_path, "hybrid", alerts_path)
    assert tables.correlated.head()["raw_source_ip"] == "1.2.3.4" and tables.error is None
    raising = adapters.read_source(spark, alerts_path, "evtx", "alerts-json").withColumn("AlertName", F.raise_error(F.lit("no alerts today")).cast("string"))
    tables = load_hybrid("case 21", adapters.read_source(spark, records_path, "evtx"), raising)
    assert tables.raw.count() == 1 and tables.alerts is None and tables.correlated is None and tables.error
    tables = ingest_records(spark, "case 22", records_path, "hybrid", str(tmp_path / "missing.json"))
    assert tables.raw.count() == 1 and tables.correlated is None and "missing.json" in tables.error
    assert ingest_records(spark, "case 23", records_path).alerts is None
    assert ingest_records(spark, "case 24", alerts_path, "alerts-json").raw.head()["AlertName"] == "Logon"
    with pytest.raises(ValueError):
        ingest_records(spark, "case 25", records_path, "other")


def test_rows_of_few_splits_are_spread(spark):
    lone = spark.range(0, 160000, 1, 40).filter("id < 4000")
    assert lone.rdd.getNumPartitions() == 40
    spread = fill_cores(lone, 100)
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 40 and max(sizes) <= 200
    even = spark.range(0, 4000, 1, 40)
    assert fill_cores(even, 100).rdd.getNumPartitions() == 40


def test_records_are_judged_once(spark):
    rows = [("1", '{"Event": {"System": {"EventID": 1}}}'), ("2", '{"Event"'), ("3", None), ("4", '{"x": "\\ud800"}'), ("5", '{"Event": {"\\ud800": 1}}')]
    good, broken = records.split_records(spark.createDataFrame(rows, "event_record_id string, data string"))
    assert sorted(r.event_record_id for r in good.collect()) == ["1", "5"] and sorted(r.event_record_id for r in broken.collect()) == ["2", "4"]
    for half in (good, broken):
        assert "ArrowEvalPython" not in half._jdf.queryExecution().toString()


def test_leaves_of_escapes_and_odd_numbers(spark):
    text = '{"Event": {"a\\ud83d": "x\\udc00", "b": [1, 2.50, true, null], "c": 1e400, "d": "\\u00e9", "e": -0.0, "f": false, "g": 12345678901234567890, "h": {}}}'
    row = spark.createDataFrame([(text,), ("[]",), (None,)], "data string").select(records.flattened(F.col("data"), "Event").alias("f")).select("f.*").collect()
    assert dict(zip(row[0]["keys"], zip(row[0].texts, row[0].jsons))) == {
        "a?": ("x?", '"x?"'), "b": ("[1, 2.5, true, null]", "[1, 2.5, true, null]"), "c": ("Infinity", "Infinity"), "d": ("é", '"é"'),
        "e": ("-0.0", "-0.0"), "f": ("false", "false"), "g": ("12345678901234567890", "12345678901234567890")}
    assert row[0].message == '{"a?": "x?", "b": [1, 2.5, true, null], "c": Infinity, "d": "é", "e": -0.0, "f": false, "g": 12345678901234567890}'
    assert all(r.message is None and r["keys"] is None for r in row[1:])
