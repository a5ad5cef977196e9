"""Sources, event records, text extraction and normalization."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logsift import constants as C
from logsift.functions.casts import event_time, status_number
from logsift.functions.text import sanitized
from logsift.operators import extract, normalize, records
from logsift.plans.hybrid import correlation_view_name, has_correlation, load_hybrid
from logsift.plans.store import EventStore, describe_tables, replace_events, write_raw
from logsift.session import materialize, scratch_path
from logsift.sources import adapters, files, lines, netsets, tabular
from logsift.streaming.ingest import stream_detected_text, stream_table_files, streamed_events
from workload import fixtures
from workload import relations as R
from workload.registry import query

# --- sources -----------------------------------------------------------------

_CSV_SQL = (
    "select cast(event_id as varchar) as event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, ip as client_ip, "
    "cast(status as varchar) as status, case when event_type <> 'click' then method end as method, "
    "'say \"' || event_type || '\", id ' || event_id as message from web_events"
)


def _csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.web_events(spark, sf).selectExpr(
        "event_id", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as timestamp", "ip as client_ip", "status",
        "if(event_type = 'click', null, method) as method",
        "concat('say \"', event_type, '\", id ', event_id) as message",
    )


def _written_csv(spark: SparkSession, sf: str, sep: str) -> str:
    path = scratch_path(spark, "csv")
    _csv_rows(spark, sf).write.csv(path, header=True, sep=sep, escape='"')
    return path


@query("s1_csv_scan", _CSV_SQL, ("web_events",))
def s1(spark: SparkSession, sf: str) -> DataFrame:
    return tabular.read_csv(spark, _written_csv(spark, sf, ","))


@query("s2_csv_sniffed", _CSV_SQL, ("web_events",))
def s2(spark: SparkSession, sf: str) -> DataFrame:
    return tabular.read_csv(spark, _written_csv(spark, sf, ";"), sep=None)


@query("s3_csv_inferred", (
    "select cast(event_id as bigint) as event_id, date_trunc('second', ts) as timestamp, ip as client_ip, "
    "cast(status as integer) as status, case when event_type <> 'click' then method end as method, "
    "'say \"' || event_type || '\", id ' || event_id as message from web_events"
), ("web_events",))
def s3(spark: SparkSession, sf: str) -> DataFrame:
    df = tabular.read_csv(spark, _written_csv(spark, sf, ","), infer=True)
    return df.withColumn("event_id", F.col("event_id").cast("bigint"))


@query("s4_json_scan", (
    "select event_id, ip, user_id, method || '|' || event_type as tags, strftime(ts, '%Y-%m-%d %H:%M:%S') as time, status "
    "from web_events"
), ("web_events",))
def s4(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "json")
    R.web_events(spark, sf).selectExpr(
        "event_id", "struct(ip, user_id) as who", "array(method, event_type) as tags",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as time", "status",
    ).write.json(path)
    return tabular.read_json(spark, path).select(
        "event_id", "who.ip", "who.user_id", F.array_join("tags", "|").alias("tags"), "time",
        F.col("status").cast("int").alias("status"),
    )


@query("s5_text_scan", "select nullif(unnest(string_split(text, chr(10))), '') as line from documents")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "text")
    R.table(spark, sf, "documents").select("text").write.text(path)
    return lines.read_lines(spark, path).select("line")


@query("s6_head_lines", (
    "select file, line from mixed_lines qualify row_number() over (partition by file order by block, pos) <= 25"
), ("mixed_lines",))
def s6(spark: SparkSession, sf: str) -> DataFrame:
    heads = lines.head_lines(lines.read_lines(spark, fixtures.log_files(spark, sf)), 25)
    return heads.select(fixtures.log_name(F.col("file")).alias("file"), "line")


@query("s7_structured_ingest", "select * from structured_lines", ("structured_lines",))
def s7(spark: SparkSession, sf: str) -> DataFrame:
    found = extract.structured_lines(lines.read_lines(spark, fixtures.log_files(spark, sf)))
    return found.withColumn("file", fixtures.log_name(F.col("file")))


@query("s8_adapter_dispatch", (
    "select fmt as format, n as n_rows, n_columns, n_hits from (values ('csv', 6), ('json', 7), ('log', 5)) f(fmt, n_columns), "
    "(select count(*) as n, count(*) filter (where status >= 400) as n_hits from web_events)"
), ("web_events",))
def s8(spark: SparkSession, sf: str) -> DataFrame:
    paths = {fmt: scratch_path(spark, fmt) for fmt in ("csv", "json", "log")}
    _csv_rows(spark, sf).write.csv(paths["csv"], header=True, escape='"')
    R.web_events(spark, sf).drop("value").write.json(paths["json"])
    R.access_lines(spark, sf).select("line").write.text(paths["log"])
    parts = []
    for fmt, path in paths.items():
        df = adapters.read_source(spark, path, fmt)
        parts.append(normalize.alias_view(df).agg(
            F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("n_rows"),
            F.lit(len(df.columns)).alias("n_columns"), F.count_if(F.col("status_code") >= 400).alias("n_hits"),
        ))
    return reduce(DataFrame.unionByName, parts)


_SNIFFED = (
    "select *, case when path like '%.CSV' then 'csv' when path like '%.evtx' then 'evtx' when path like '%.log' then 'log' "
    "when head is null or first_line = '' then null when regexp_matches(first_line, '^[\\{\\[]') then 'json' "
    "when contains(first_line, ',') and regexp_matches(first_line, '^[\\pL\\pN]') then 'csv' else 'log' end as format from ("
    "select *, regexp_extract(head, '^\\s*([^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]*)', 1) as first_line "
    "from document_files)"
)
# Of equal files the first keeps its own status.
_CATALOG = (
    "select *, case when row_number() over (partition by content_key order by path) > 1 then 'duplicate' "
    f"when length = 0 or format is null then 'invalid' else 'ready' end as status from ({_SNIFFED})"
)


def _catalog(spark: SparkSession, sf: str, override: str | None = None) -> DataFrame:
    folder = fixtures.document_files(spark, sf)
    return fixtures.relative(folder, files.catalog(spark, folder, override))


@query("s9_format_detection", f"select path, case when length > 0 then format end as format from ({_SNIFFED})", ("document_files",))
def s9(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).select("path", "format")


@query("s10_file_validation", (
    "select path, status, case when length = 0 then 'Log file is empty: ' || path when format is null then 'Unsupported binary file format for ' || path end "
    f"as validation_error, case when length > 0 then format = 'evtx' end as needs_conversion from ({_CATALOG})"
), ("document_files",))
def s10(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).select("path", "status", "validation_error", "needs_conversion")


@query("s11_type_override", (
    f"select path, case when length > 0 and format is not null then 'json' end as format from ({_SNIFFED})"
), ("document_files",))
def s11(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf, override="JSON").select("path", "format")


@query("s12_duplicate_files", f"select path, status from ({_CATALOG})", ("document_files",))
def s12(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).select("path", "status")


@query("s13_file_preview", (
    "select file, rn as line_no, substring(line, 1, cast(4096 - before as integer)) as line from ("
    "select file, line, rn, coalesce(sum(octet_length(encode(line)) + 1) over (partition by file order by rn "
    "rows between unbounded preceding and 1 preceding), 0) as before from ("
    "select file, line, cast(row_number() over (partition by file order by block, pos) as integer) as rn from mixed_lines) "
    "where rn <= 60) where before < 4096"
), ("mixed_lines",))
def s13(spark: SparkSession, sf: str) -> DataFrame:
    shown = lines.preview(lines.read_lines(spark, fixtures.log_files(spark, sf)), 60, 4096)
    return shown.withColumn("file", fixtures.log_name(F.col("file")))


@query("s14_netset_scan", "select list_name, cidr from netset", ("netset",))
def s14(spark: SparkSession, sf: str) -> DataFrame:
    return R.netset(spark, sf)


@query("s15_table_profile", (
    "select 'lineitem' as table_name, (select count(*) from lineitem) as row_count, cast(ordinal_position - 1 as integer) as ordinal, "
    "column_name, case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' "
    "when 'VARCHAR' then 'string' else 'timestamp_ntz' end as dtype from information_schema.columns where table_name = 'lineitem'"
))
def s15(spark: SparkSession, sf: str) -> DataFrame:
    return tabular.profile(R.table(spark, sf, "lineitem"), "lineitem")


@query("s16_table_preview", (
    "select event_id, '{\"ip\":\"' || ip || '\",\"status\":' || status || '}' as src, "
    "'[\"' || method || '\",\"' || event_type || '\"]' as tags, method as raw from web_events order by event_id limit 100"
), ("web_events",))
def s16(spark: SparkSession, sf: str) -> DataFrame:
    nested = R.web_events(spark, sf).selectExpr(
        "event_id", "struct(ip, status) as src", "array(method, event_type) as tags", "cast(method as binary) as raw"
    )
    return tabular.preview_rows(nested.orderBy("event_id"))


@query("s17_status_counts", (
    "select s.status, count(d.path) as n_files from (values ('ready'), ('pending'), ('ingested'), ('invalid'), ('error')) s(status) "
    f"left join ({_CATALOG}) d on s.status = d.status group by s.status"
), ("document_files",))
def s17(spark: SparkSession, sf: str) -> DataFrame:
    return files.status_counts(_catalog(spark, sf))


@query("c7_file_sizes", (
    "select path, case when length >= 1048576 then printf('%.1f MB', length / 1048576.0::double) "
    "when length >= 1024 then printf('%.1f KB', length / 1024.0::double) else length || ' B' end as size_text, "
    "length > 104857600 as is_large from document_files"
), ("document_files",))
def c7(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).select("path", "size_text", "is_large")


@query("c9_list_freshness", (
    "select list_name, count(as_of) > 0 as loaded, count(as_of) = 0 or "
    "max(as_of) < timestamp '2024-01-02 00:00:00' as stale from (select lower(c_mktsegment) || '_' || c_nationkey as list_name, "
    "case when c_nationkey % 5 = 1 then null when c_custkey % 3 = 0 then timestamp '2024-01-01 06:00:00' + to_minutes(cast(c_custkey as integer)) "
    "else timestamp '2024-01-01 00:00:00' + to_minutes(cast(c_custkey as integer)) end as as_of from customer) group by list_name"
))
def c9(spark: SparkSession, sf: str) -> DataFrame:
    seen = R.table(spark, sf, "customer").selectExpr(
        "concat(lower(c_mktsegment), '_', c_nationkey) as list_name",
        "timestampadd(MINUTE, cast(c_custkey as int), timestamp'2024-01-01 00:00:00') as modified",
        "case when c_custkey % 3 = 0 then date_format(timestampadd(MINUTE, cast(c_custkey as int), "
        "timestamp'2024-01-01 06:00:00'), \"yyyy-MM-dd'T'HH:mm:ss\") when c_custkey % 3 = 1 then 'soon' end as fetched_at",
        "c_nationkey",
    )
    present = seen.filter("c_nationkey % 5 <> 1")
    return netsets.list_freshness(seen, present, F.lit("2024-01-03 00:00:00").cast("timestamp"), 24)


@query("e7_refresh_summary", (
    "select outcome, count(*) as n_results, count(distinct list_name) as n_lists from (select lower(c_mktsegment) as list_name, "
    "case when c_nationkey < 10 then 'updated' when c_nationkey < 20 then 'cached' else 'error' end as outcome from customer) group by outcome"
))
def e7(spark: SparkSession, sf: str) -> DataFrame:
    log = R.table(spark, sf, "customer").selectExpr(
        "lower(c_mktsegment) as list_name",
        "case when c_nationkey < 5 then 'updated' when c_nationkey < 10 then 'unchanged' when c_nationkey < 20 then 'cached' "
        "else concat('error: HTTP ', 500 + c_nationkey) end as status",
    )
    return netsets.refresh_summary(log)


# --- event records -----------------------------------------------------------


@query("ev1_named_data", (
    "select event_id as record_id, unnest(['EventData_Data_IpAddress', 'EventData_Data_StatusCode']) as key, "
    "unnest([ip, cast(status as varchar)]) as value from web_events where event_type <> 'view' union all "
    "select event_id, 'EventData_Tags', '[\"view\", \"beta\"]' from web_events where event_type = 'view'"
), ("web_events",))
def ev1(spark: SparkSession, sf: str) -> DataFrame:
    data, tags = F.get_json_object("data", "$.Event.EventData.Data"), F.get_json_object("data", "$.Event.EventData.Tags")
    rows = R.event_records(spark, sf).withColumn("items", F.coalesce(data, tags)).withColumn(
        "parent", F.when(data.isNotNull(), "EventData_Data").otherwise("EventData_Tags")
    )
    entries = records.flatten_payload(rows, "items", "flat", parent=F.col("parent"))
    return entries.select(F.col("event_record_id").alias("record_id"), F.explode("flat")).select("record_id", "key", F.col("value.text").alias("value"))


def _flat_records(spark: SparkSession, sf: str) -> DataFrame:
    return records.flatten_payload(R.event_records(spark, sf), "data", "flat", element="Event")


@query("ev2_flatten_payload", (
    "select event_id as record_id, unnest(['System_Channel', 'System_Computer', 'System_EventID', 'System_Level', "
    "'System_Load', 'System_Mix', 'System_Provider_Name', 'System_Ratio', 'System_Task', 'System_TimeCreated_SystemTime', 'System_b_c']) as key, "
    "unnest(['\"Security\"', '\"HOST-' || (user_id % 20) || '\"', cast(4600 + event_id % 50 as varchar), '0', '1.0', '[{\"a\": [2.5, \"x\"], \"z\": 1}]', "
    "'\"Audit\"', '1e+22', '12544', '\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z\"', cast(2 - event_id % 2 as varchar)]) as value from web_events union all "
    "select event_id, 'System_d1_d2_d3_d4_d5_d6_d7_d8_d9', cast(event_id as varchar) from web_events where event_id % 10 = 0 union all "
    "select event_id, unnest(['EventData_Data_IpAddress', 'EventData_Data_StatusCode']), "
    "unnest(['\"' || ip || '\"', cast(status as varchar)]) from web_events where event_type <> 'view' union all "
    "select event_id, 'EventData_Tags', '[\"view\", \"beta\"]' from web_events where event_type = 'view'"
), ("web_events",))
def ev2(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_records(spark, sf).select(F.col("event_record_id").alias("record_id"), F.explode("flat")).select(
        "record_id", "key", F.col("value.json").alias("value")
    )


@query("ev3_first_non_empty", (
    "select event_id as record_id, case when event_type <> 'view' then ip end as source_ip, "
    "case when event_type <> 'view' then cast(status as varchar) end as status_code from web_events"
), ("web_events",))
def ev3(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_records(spark, sf).select(
        F.col("event_record_id").alias("record_id"),
        records.first_of(F.col("flat"), C.RECORD_ADDRESS_KEYS).alias("source_ip"),
        records.first_of(F.col("flat"), C.RECORD_STATUS_KEYS).alias("status_code"),
    )


@query("ev4_record_rows", "select * from record_rows", ("record_rows",))
def ev4(spark: SparkSession, sf: str) -> DataFrame:
    return records.record_rows(R.event_records(spark, sf))


@query("ev5_record_guard", (
    "select case when status = 500 then 'broken' when event_type = 'signup' then 'missing' else 'good' end as quality, count(*) as n "
    "from web_events group by 1 having quality <> 'missing'"
), ("web_events",))
def ev5(spark: SparkSession, sf: str) -> DataFrame:
    damaged = R.event_records(spark, sf).join(
        R.web_events(spark, sf).select(F.col("event_id").alias("event_record_id"), "status", "event_type"), "event_record_id"
    ).withColumn(
        "data",
        F.when(F.col("status") == 500, F.expr("substring(data, 1, length(data) - 3)"))
        .when(F.col("event_type") != "signup", F.col("data")),
    )
    good, broken = records.split_records(damaged)
    return reduce(DataFrame.unionByName, [
        df.agg(F.lit(name).alias("quality"), F.count(F.lit(1)).alias("n")) for name, df in (("good", good), ("broken", broken))
    ])


@query("ev6_record_preview", (
    "select record_id, timestamp, event as event_id, provider, channel, '#' || record_id || ' | ' || timestamp || ' | EventID=' || event || "
    "' | ' || provider || ' | ' || channel as line from record_rows order by cast(record_id as bigint) limit 50"
), ("record_rows",))
def ev6(spark: SparkSession, sf: str) -> DataFrame:
    return records.record_preview(R.event_records(spark, sf))


_ALERTS_SQL = (
    'select "Timestamp", "Computer", "Channel", cast("RecordID" as varchar) as "RecordID", "AlertName" from alerts'
)


@query("ev7_alert_scan", f"{_ALERTS_SQL} union all {_ALERTS_SQL}", ("alerts",))
def ev7(spark: SparkSession, sf: str) -> DataFrame:
    csv_path, json_path = scratch_path(spark, "alerts"), scratch_path(spark, "alerts")
    R.alerts(spark, sf).write.csv(csv_path, header=True, escape='"')
    R.alerts(spark, sf).write.json(json_path)
    from_csv = adapters.read_source(spark, csv_path, "evtx", "alerts-csv")
    from_json = adapters.read_source(spark, json_path, "evtx", "alerts-json")
    return from_csv.unionByName(from_json.withColumn("RecordID", F.col("RecordID").cast("string")))


_CORRELATED_SQL = (
    'select a.*, r.message as raw_message, r.source_ip as raw_source_ip, r.status_code as raw_status_code, '
    'r.provider as raw_provider, r.level as raw_level, r.task as raw_task from alerts a left join record_rows r on '
    'cast(a."RecordID" as varchar) = r.record_id and a."Channel" = r.channel and a."Computer" = r.computer '
    'and a."Timestamp" = r.timestamp'
)


@query("ev8_hybrid_load", (
    f"select 'correlated' as part, count(*) as n_rows, count(raw_source_ip) as n_matched from ({_CORRELATED_SQL}) union all "
    "select 'raw', count(*), count(source_ip) from record_rows union all select 'alerts', count(*), count(\"RecordID\") from alerts"
), ("alerts", "record_rows"))
def ev8(spark: SparkSession, sf: str) -> DataFrame:
    tables = load_hybrid("case 1", records.record_rows(R.event_records(spark, sf)), R.alerts(spark, sf))
    parts = (("correlated", tables.correlated, "raw_source_ip"), ("raw", tables.raw, "source_ip"),
             ("alerts", tables.alerts, "RecordID"))
    return reduce(DataFrame.unionByName, [
        df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_rows"), F.count(col).alias("n_matched"))
        for name, df, col in parts
    ])


@query("j1_correlated_alerts", _CORRELATED_SQL, ("alerts", "record_rows"))
def j1(spark: SparkSession, sf: str) -> DataFrame:
    raw = materialize(records.record_rows(R.event_records(spark, sf)), "raw")
    return records.correlate_alerts(R.alerts(spark, sf), raw)


@query("j2_correlation_available", (
    "select true as available, 'correlated_case_2' as view_name, (select count(*) from alerts) as n_alerts"
), ("alerts",))
def j2(spark: SparkSession, sf: str) -> DataFrame:
    load_hybrid("case 2", records.record_rows(R.event_records(spark, sf)), R.alerts(spark, sf))
    name = correlation_view_name("case 2")
    return spark.table(name).agg(
        F.lit(has_correlation(spark, "case 2")).alias("available"), F.lit(name).alias("view_name"),
        F.count(F.lit(1)).alias("n_alerts"),
    )


# --- text --------------------------------------------------------------------


@query("p1_detect_formats", "select file, format from file_formats", ("file_formats",))
def p1(spark: SparkSession, sf: str) -> DataFrame:
    found = extract.detect_formats(lines.read_lines(spark, fixtures.log_files(spark, sf)))
    return found.select(fixtures.log_name(F.col("file")).alias("file"), "format")


def _fields_sql(fmt: str, relation: str) -> str:
    fields = ", ".join(f"{sql} as {f}" for f, sql in R.duck_fields(fmt).items())
    return f"select pos, {fields}, line as raw_message from {relation}"


@query("p2_web_fields", _fields_sql("web", "access_lines"), ("access_lines",))
def p2(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(R.access_lines(spark, sf), "web").drop("file", "block")


@query("p3_syslog_fields", _fields_sql("syslog", "syslog_lines"), ("syslog_lines",))
def p3(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(R.syslog_lines(spark, sf), "syslog").drop("file", "block")


@query("p4_json_fields", _fields_sql("jsonline", "json_lines"), ("json_lines",))
def p4(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(R.json_lines(spark, sf), "jsonline").drop("file", "block")


_HIT = "coalesce(event_timestamp, '') <> '' or coalesce(source_ip, '') <> '' or coalesce(event_type, '') <> ''"


@query("p5_hit_counts", (
    f"select file, count(*) filter (where {_HIT}) as hits, count(*) as n_lines from "
    f"(select file, {', '.join(f'{sql} as {f}' for f, sql in R.duck_fields('jsonline').items())} from mixed_lines) group by file"
), ("mixed_lines",))
def p5(spark: SparkSession, sf: str) -> DataFrame:
    return extract.hit_counts(extract.extract(R.mixed_lines(spark, sf), "jsonline"), ["file"])


_TIME_SHAPES = (
    ("dd/MMM/yyyy:HH:mm:ss", "%d/%b/%Y:%H:%M:%S", " +0200"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "-05:30"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "Z"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSS", "%Y-%m-%dT%H:%M:%S.%g", ""),
    ("MMM dd HH:mm:ss", "%b %d %H:%M:%S", ""),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", ""),
    ("yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S", ""),
    ("yyyy-MM-dd", "%Y-%m-%d", ""),
    ("HH:mm:ss", "%H:%M:%S", ""),
)


def _shape_sql(duck: bool) -> str:
    epoch = "cast(cast(floor(epoch(ts)) as bigint) as varchar)" if duck else "cast(unix_seconds(cast(ts as timestamp)) as string)"
    cases = [f"when 0 then {epoch}"]
    for i, (spark_format, duck_format, suffix) in enumerate(_TIME_SHAPES, 1):
        text = f"strftime(ts, '{duck_format}')" if duck else f'date_format(ts, "{spark_format}")'
        cases.append(f"when {i} then concat({text}, '{suffix}')")
    return f"case event_id % {len(_TIME_SHAPES) + 2} {' '.join(cases)} else 'n/a' end"


@query("p6_event_times", (
    f"select event_id, text, {R.duck_time('text')} as event_timestamp from (select event_id, {_shape_sql(True)} as text from events)"
))
def p6(spark: SparkSession, sf: str) -> DataFrame:
    texts = R.wide_table(spark, sf, "events").selectExpr("event_id", f"{_shape_sql(False)} as text")
    return texts.withColumn("event_timestamp", event_time(F.col("text"), T.StringType()))


_STATUS_TEXTS = (
    "case event_id % 6 when 0 then cast(status as {s}) when 1 then concat(' ', status, ' ') when 2 then concat(status, ' OK') "
    "when 3 then '' when 4 then concat(status, '.6') else '4e2' end"
)


@query("p7_status_numbers", (
    "select event_id, text, try_cast(nullif(trim(text), '') as bigint) as status_code from "
    f"(select event_id, {_STATUS_TEXTS.format(s='varchar')} as text from web_events)"
), ("web_events",))
def p7(spark: SparkSession, sf: str) -> DataFrame:
    texts = R.web_events(spark, sf).selectExpr("event_id", f"{_STATUS_TEXTS.format(s='string')} as text")
    return texts.withColumn("status_code", status_number(F.col("text"), T.StringType(), "bigint"))


_PROFILED = {"web": "access_lines", "syslog": "syslog_lines", "jsonlog": "json_lines", "ambiguous": "unclear_lines"}


def _profile_sql(profile: str, relation: str) -> str:
    patterns = C.PROFILE_FIELDS[profile]
    counts = ", ".join(
        (f"count(*) filter (where regexp_extract(line, '{patterns[n]}', 1) <> '')" if n in patterns else "cast(0 as bigint)") + f" as {n}"
        for n in ("timestamp", "source_ip", "status_code", "event_type")
    )
    return f"select '{profile}' as profile, count(*) as n_lines, {counts} from {relation}"


@query("p8_field_profile", " union all ".join(_profile_sql(p, r) for p, r in _PROFILED.items()), tuple(_PROFILED.values()))
def p8(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        extract.field_profile(getattr(R, relation)(spark, sf), profile).withColumn("profile", F.lit(profile))
        for profile, relation in _PROFILED.items()
    ])


_EVENT_NULLS = (
    "cast(null as timestamp) as event_timestamp, cast(null as varchar) as source_ip, cast(null as varchar) as event_type, "
    "cast(null as integer) as status_code, {raw} as raw_message, cast(null as varchar) as process_name, "
    "cast(null as varchar) as destination_ip"
)


@query("p9_missing_fields", f"select {_EVENT_NULLS.format(raw='cast(null as varchar)')} from part")
def p9(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize(R.table(spark, sf, "part").selectExpr("p_name as foo", "p_brand as bar"))[0]


@query("u1_sanitized_names", (
    "select p_partkey, case when regexp_matches(safe, '^([0-9]|$)') then '_' || safe else safe end as table_name from ("
    "select p_partkey, regexp_replace(case when p_size % 3 = 0 then p_partkey || ' ' || p_name when p_size % 3 = 1 then p_brand "
    "else '' end, '[^a-zA-Z0-9_]', '_', 'g') as safe from part)"
))
def u1(spark: SparkSession, sf: str) -> DataFrame:
    name = F.expr("case when p_size % 3 = 0 then concat(p_partkey, ' ', p_name) when p_size % 3 = 1 then p_brand else '' end")
    return R.table(spark, sf, "part").select("p_partkey", sanitized(name).alias("table_name"))


# --- normalization -----------------------------------------------------------


def _source_a(spark: SparkSession, sf: str) -> DataFrame:
    return R.web_fields(spark, sf).selectExpr(
        "event_timestamp as Timestamp", "source_ip as Client_IP", "status_code as STATUS", "event_type as method"
    )


def _source_b(spark: SparkSession, sf: str) -> DataFrame:
    return R.web_events(spark, sf).selectExpr(
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as time", "ip as remote_addr", "if(status = 200, null, status) as response_code",
        "concat(status, ' ') as code", "event_type as action", "if(event_id % 2 = 0, null, method) as message", "value as raw",
    )


_SOURCE_A = (
    f"select {R.duck_time('event_timestamp')} as event_timestamp, source_ip, event_type, try_cast(status_code as integer) as status_code, "
    "cast(null as varchar) as raw_message, cast(null as varchar) as process_name, cast(null as varchar) as destination_ip from web_fields"
)
_SOURCE_B = (
    "select date_trunc('second', ts) as event_timestamp, ip as source_ip, event_type, status as status_code, "
    "coalesce(case when event_id % 2 <> 0 then method end, cast(value as varchar)) as raw_message, cast(null as varchar) as process_name, "
    "cast(null as varchar) as destination_ip from web_events"
)


@query("n1_alias_matches", (
    "select target, source, (select count(*) from web_events) as n_rows from (values ('event_timestamp', 'Timestamp'), "
    "('source_ip', 'Client_IP'), ('event_type', 'method'), ('status_code', 'STATUS')) m(target, source)"
), ("web_events",))
def n1(spark: SparkSession, sf: str) -> DataFrame:
    source = _source_a(spark, sf)
    matched = [(t, m) for t in C.EVENT_COLUMNS for m in normalize.find_matches(source.columns, t)]
    counted = source.agg(F.count(F.lit(1)).alias("n_rows"))
    return spark.createDataFrame(matched, "target string, source string").withColumn("n_rows", counted.scalar())


@query("n2_normalized_source", _SOURCE_B, ("web_events",))
def n2(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize(_source_b(spark, sf))[0]


@query("n3_replaced_events", _SOURCE_A, ("web_fields",))
def n3(spark: SparkSession, sf: str) -> DataFrame:
    return replace_events(_source_a(spark, sf), scratch_path(spark, "events"))[1]


def _two_sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {"raw_a": _source_a(spark, sf), "raw_b": _source_b(spark, sf)}


_BOTH = f"select *, 'raw_a' as source from ({_SOURCE_A}) union all select *, 'raw_b' as source from ({_SOURCE_B})"


@query("n4_appended_batches", _BOTH, ("web_fields", "web_events"))
def n4(spark: SparkSession, sf: str) -> DataFrame:
    store = EventStore(spark, scratch_path(spark, "store"))
    sources = _two_sources(spark, sf)
    store.append({"raw_a": sources["raw_a"]})
    store.append(sources)
    store.append(sources)
    return store.events()


_BY_FILE = (
    f"select *, 'raw_a-' || split_part(source_ip, '.', 4) as source from ({_SOURCE_A}) union all "
    f"select *, 'raw_b-' || split_part(source_ip, '.', 4) as source from ({_SOURCE_B})"
)


def _source_files(spark: SparkSession, sf: str) -> str:
    return fixtures.source_files(spark, sf, _two_sources(spark, sf), {"raw_a": "Client_IP", "raw_b": "remote_addr"})


@query("n4_appended_files", _BY_FILE, ("web_fields", "web_events"))
def n4_files(spark: SparkSession, sf: str) -> DataFrame:
    store = EventStore(spark, scratch_path(spark, "store"))
    for _ in range(2):
        store.append_files(_source_files(spark, sf))
    return store.events().withColumn("source", fixtures.log_name(F.col("source")))


@query("n5_rebuilt_files", _BY_FILE, ("web_fields", "web_events"))
def n5_files(spark: SparkSession, sf: str) -> DataFrame:
    store = EventStore(spark, scratch_path(spark, "store"))
    store.append({"raw_a": _two_sources(spark, sf)["raw_b"]})
    store.rebuild_files(_source_files(spark, sf))
    return store.events().withColumn("source", fixtures.log_name(F.col("source")))


@query("x1_union_of_files", _BY_FILE, ("web_fields", "web_events"))
def x1_files(spark: SparkSession, sf: str) -> DataFrame:
    layouts = tabular.csv_layouts(spark, _source_files(spark, sf))
    return normalize.normalize_layouts([df for _, df in layouts]).withColumn("source", fixtures.log_name(F.col("source")))


@query("n4_appended_stream", f"{_SOURCE_A} union all {_SOURCE_A}", ("web_fields",))
def n4_stream(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "stream")
    raw = _source_a(spark, sf)
    schema = ", ".join(f"{c} {t}" for c, t in raw.dtypes)
    for _ in range(2):
        raw.write.mode("append").parquet(f"{base}/raw")
        for _ in range(2):
            stream_table_files(spark, f"{base}/raw", schema, f"{base}/events", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/events")


@query("n4_detected_text_stream", (
    f"select {R.duck_time('event_timestamp')} as event_timestamp, source_ip, event_type, try_cast(status_code as integer) as status_code, raw_message, "
    "cast(null as varchar) as process_name, cast(null as varchar) as destination_ip from structured_lines where structured"
), ("structured_lines",))
def n4_text_stream(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "stream")
    rows = R.mixed_lines(spark, sf).withColumn("early", F.col("file").rlike("^(web|sys)"))
    for arrival in (F.col("early"), ~F.col("early")):
        fixtures.write_log_files(rows.filter(arrival), f"{base}/raw")
        for _ in range(2):
            stream_detected_text(spark, f"{base}/raw", f"{base}/events", f"{base}/formats", f"{base}/checkpoint").awaitTermination()
    return streamed_events(spark, f"{base}/events")


@query("n5_rebuilt_events", _BOTH, ("web_fields", "web_events"))
def n5(spark: SparkSession, sf: str) -> DataFrame:
    store = EventStore(spark, scratch_path(spark, "store"))
    sources = _two_sources(spark, sf)
    store.append({"raw_a": sources["raw_b"]})
    store.rebuild(sources)
    return store.events()


@query("n6_alias_view", (
    "select date_trunc('second', ts) as event_timestamp, ip as source_ip, event_type, cast(null as bigint) as status_code, "
    "case when event_id % 2 <> 0 then method end as raw_message, cast(null as varchar) as process_name, "
    "cast(null as varchar) as destination_ip from web_events where status = 200 union all "
    "select date_trunc('second', ts), ip, event_type, cast(status as bigint), case when event_id % 2 <> 0 then method end, null, null "
    "from web_events where status <> 200"
), ("web_events",))
def n6(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.alias_view(_source_b(spark, sf).drop("code"))


@query("n7_raw_tables", (
    "select 'raw_access' as table_name, count(*) as row_count, 'Timestamp, Client_IP, STATUS, method' as columns, true as analyzable "
    "from events union all select 'raw_parts', count(*), 'p_name, p_brand', false from part"
))
def n7(spark: SparkSession, sf: str) -> DataFrame:
    _source_a(spark, sf).createOrReplaceTempView("raw_access")
    R.table(spark, sf, "part").select("p_name", "p_brand").createOrReplaceTempView("raw_parts")
    R.unified_events(spark, sf).createOrReplaceTempView("events")
    return describe_tables(spark).filter(F.col("table_name").isin("raw_access", "raw_parts", "events"))


@query("n8_analyzable_tables", (
    "select 'part' as table_name, count(*) as row_count, false as analyzable from part union all "
    "select 'orders', count(*), false from orders union all select 'events', count(*), true from events"
))
def n8(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
               F.lit(normalize.is_analyzable(df.columns)).alias("analyzable"))
        for name in ("part", "orders", "events") for df in [R.table(spark, sf, name)]
    ])


@query("n9_unstructured_gate", (
    f"select *, 'raw_a' as source from ({_SOURCE_A}) union all "
    f"select {_EVENT_NULLS.format(raw='line')}, 'raw_lines' as source from unclear_lines"
), ("web_fields", "unclear_lines"))
def n9(spark: SparkSession, sf: str) -> DataFrame:
    sources = {"raw_a": _source_a(spark, sf), "raw_lines": R.unclear_lines(spark, sf).select("line")}
    gated = normalize.normalize_all(sources)
    opened = normalize.normalize_all({"raw_lines": sources["raw_lines"]}, include_unstructured=True)
    return gated.unionByName(opened)


@query("x1_union_of_sources", _BOTH, ("web_fields", "web_events"))
def x1(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize_all(_two_sources(spark, sf))


@query("k1_raw_table", "select event_timestamp, source_ip, status_code, event_type, raw_message from web_fields", ("web_fields",))
def k1(spark: SparkSession, sf: str) -> DataFrame:
    return write_raw(R.web_fields(spark, sf), scratch_path(spark, "raw"))


@query("m3_row_counts", "select 'events' as table_name, count(*) as row_count from events")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    return R.unified_events(spark, sf).agg(F.lit("events").alias("table_name"), F.count(F.lit(1)).alias("row_count"))
