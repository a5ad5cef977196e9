"""Log-shaped relations derived from the given tables, in Spark and as SQL.

The tables hold no addresses, status codes or log lines. Each relation below derives
them with plain expressions over a whole table, once for Spark and once, under the
same name, as a common table expression for the SQL side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from logsift import constants as C
from logsift.operators import extract, normalize
from logsift.plans.shapes import fill_cores
from logsift.sources.netsets import parse_netset_lines


_SCANS: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its scan is planned once per application, so its schema is read once."""
    key = (spark.sparkContext.applicationId, f"{sf}/{name}.parquet")
    if key not in _SCANS:
        _SCANS[key] = spark.read.parquet(key[1])
    return _SCANS[key]


# Events in one task that opens their records.
RECORD_ROWS = 50_000


def wide_table(spark: SparkSession, sf: str, name: str, task_rows: int | None = None) -> DataFrame:
    """A given table for CPU-heavy expressions: on all cores even if it is one small file, with at most about ``task_rows`` rows in a task."""
    key = (spark.sparkContext.applicationId, f"{sf}/{name}.parquet on all cores, {task_rows}")
    if key not in _SCANS:
        _SCANS[key] = fill_cores(table(spark, sf, name), task_rows)
    return _SCANS[key]


# --- Spark -------------------------------------------------------------------

_IP = "concat('10.0.', cast((user_id div 250) % 256 as string), '.', cast(user_id % 250 + 1 as string))"
_STATUS = (
    "case when event_type = 'error' then case event_id % 4 when 0 then 404 when 1 then 500 when 2 then 403 else 401 end "
    "when event_type = 'signup' then 201 when event_type = 'click' then 302 else 200 end"
)
_METHOD = "case event_type when 'purchase' then 'POST' when 'signup' then 'PUT' else 'GET' end"


def web_events(spark: SparkSession, sf: str, task_rows: int | None = None) -> DataFrame:
    return wide_table(spark, sf, "events", task_rows).selectExpr(
        "event_id", "ts", "user_id", "event_type", "value", f"{_IP} as ip", f"{_STATUS} as status",
        f"{_METHOD} as method",
    )


def _lines(df: DataFrame, prefix: str, line: str) -> DataFrame:
    return df.selectExpr(
        f"concat('{prefix}-', cast(user_id % 20 as string)) as file", "event_id div 1000 as block",
        "event_id as pos", f"{line} as line",
    )


def access_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(web_events(spark, sf), "web", (
        "concat(ip, ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"', method, ' /', event_type, '/', "
        "event_id, ' HTTP/1.1\" ', status, ' ', user_id)"
    ))


def syslog_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(web_events(spark, sf), "sys", (
        "concat(date_format(ts, 'MMM dd HH:mm:ss'), ' srv-', user_id % 20, ' ', event_type, 'd[', event_id, "
        "']: Failed login', if(event_id % 2 = 0, concat(' from ', ip), ''), ' port 22')"
    ))


def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(web_events(spark, sf), "app", (
        "concat('{\"ts\":', if(event_id % 2 = 1, cast(unix_seconds(cast(ts as timestamp)) as string), "
        "concat('\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z\"')), ',\"component\":\"', event_type, "
        "'\",\"src_ip\":\"', ip, '\",\"status\":', status, '}')"
    ))


def unclear_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(web_events(spark, sf), "amb", (
        "concat('[', date_format(ts, 'HH:mm:ss'), '] heartbeat OK code=', status, ' len=', event_id)"
    ))


def empty_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(web_events(spark, sf), "nul", "concat('{\"time\":null,\"k\":\"', event_type, '\"}')")


def mixed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Five kinds of text files as one lines table."""
    parts = (access_lines, syslog_lines, json_lines, unclear_lines, empty_json_lines)
    return reduce(DataFrame.unionByName, [p(spark, sf) for p in parts])


def web_fields(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(access_lines(spark, sf), "web").select(*extract.FIELDS, "raw_message")


def unified_events(spark: SparkSession, sf: str) -> DataFrame:
    """Access lines through extraction and normalization."""
    return normalize.normalize(web_fields(spark, sf))[0]


def network_events(spark: SparkSession, sf: str) -> DataFrame:
    return wide_table(spark, sf, "lineitem").selectExpr(
        "l_shipdate as event_timestamp",
        "concat('10.1.', (l_suppkey div 250) % 256, '.', l_suppkey % 250 + 1) as source_ip",
        "if(l_linenumber <= 5, 'Network Connection', 'Process Create') as event_type",
        "cast(null as int) as status_code",
        "cast(null as string) as raw_message",
        "if(l_partkey % 97 = 0, null, concat('proc_', l_partkey % 400, '.exe')) as process_name",
        "concat('198.51.100.', l_suppkey % 250 + 1) as destination_ip",
    )


def all_events(spark: SparkSession, sf: str) -> DataFrame:
    return unified_events(spark, sf).unionByName(network_events(spark, sf))


def netset_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "lower(c_mktsegment) as list_name",
        "case c_nationkey when 7 then concat('# ', c_name) when 11 then 'not-a-cidr' when 13 then '   ' "
        "else concat('  10.0.', (c_custkey div 250) % 256, '.', c_custkey % 250, '/', 20 + c_custkey % 13, ' ') end as line",
    )


def netset(spark: SparkSession, sf: str) -> DataFrame:
    return parse_netset_lines(netset_lines(spark, sf))


def netset_v6(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "lower(c_mktsegment) as list_name",
        "concat('2001:DB8:', hex(c_custkey % 65536), '::/', if(c_nationkey < 5, '44', '48')) as cidr",
    )


def addresses_v6(spark: SparkSession, sf: str) -> DataFrame:
    return wide_table(spark, sf, "orders").selectExpr(
        "concat('2001:db8:', lower(hex(o_custkey % 65536)), '::', lower(hex(o_orderkey % 65536))) as ip"
    )


def allowlist(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").filter("c_mktsegment in ('BUILDING', 'MACHINERY')").selectExpr(
        "concat('entry-', c_custkey) as id",
        "concat('10.0.', (c_custkey div 250) % 256, '.', c_custkey % 250 + 1) as indicator",
        "if(c_mktsegment = 'MACHINERY', 'hash', 'ip') as indicator_type",
        "c_name as description",
        "concat('{\"nation\":', c_nationkey, '}') as metadata",
        "timestampadd(MINUTE, cast(c_custkey as int), timestamp_ntz'2024-01-01 00:00:00') as created_at",
    )


def documents_as_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "concat('/in/', source, '/doc', lpad(cast(doc_id as string), 12, '0'), "
        "case lang when 'de' then '.CSV' when 'es' then '.evtx' when 'fr' then '.log' else '' end) as path",
        "cast(octet_length(text) as bigint) as length",
        "substring(text, 1, 4096) as head",
        "sha2(text, 256) as content_key",
    )


# Where a document lies as a file; the same text in Spark SQL and DuckDB but for the cast.
_PATH = (
    "concat(source, '/doc ', lpad(cast(doc_id as {text}), 12, '0'), case doc_id % 5 when 0 then ' 5%20+' when 1 then ' é' else '' end, "
    "case lang when 'de' then '.CSV' when 'es' then '.evtx' when 'fr' then '.log' else '' end)"
)
DOCUMENT_PATH = _PATH.format(text="string")


def document_ips(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(
        "doc_id", r"explode(regexp_extract_all(text, r'([0-9]{1,3}(?:\.[0-9]{1,3}){3})', 1)) as source_ip"
    )


def _record_data(system: str, data: str) -> str:
    return f"concat('{{\"Event\":{{\"System\":{{', {system}, '}},\"EventData\":{{', {data}, '}}}}}}')"


def event_records(spark: SparkSession, sf: str) -> DataFrame:
    system = (
        "'\"Provider\":{\"#attributes\":{\"Name\":\"Audit\"}},\"EventID\":', 4600 + event_id % 50, ',\"Level\":0,\"Task\":12544,"
        "\"TimeCreated\":{\"#attributes\":{\"SystemTime\":\"', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z\"}},"
        "\"Channel\":\"Security\",\"Computer\":\"HOST-', user_id % 20, '\",\"Load\":1.0,\"Ratio\":1e+22,\"Mix\":[{\"z\":1,\"a\":[2.50,\"x\"]}],', "
        # Two members that flatten to one name, in both orders, and one nine levels down.
        "if(event_id % 2 = 0, '\"b_c\":1,\"b\":{\"c\":2}', '\"b\":{\"c\":2},\"b_c\":1'), if(event_id % 10 = 0, concat("
        f"',{''.join(chr(34) + f'd{i}' + chr(34) + ':{' for i in range(1, 9))}\"d9\":', event_id, '{'}' * 8}'), '')"
    )
    named = (
        "concat('\"Data\":[{\"#attributes\":{\"Name\":\"IpAddress\"},\"#text\":\"', ip, "
        "'\"},{\"#attributes\":{\"Name\":\"StatusCode\"},\"#text\":', status, '}]')"
    )
    plain = "concat('\"Tags\":[\"', event_type, '\",\"beta\"]')"
    return web_events(spark, sf, RECORD_ROWS).selectExpr(
        "event_id as event_record_id",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as timestamp",
        f"{_record_data(system, f'if(event_type = \"view\", {plain}, {named})')} as data",
    )


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return web_events(spark, sf).filter("event_type = 'error'").selectExpr(
        "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z') as Timestamp",
        "concat('HOST-', user_id % 20) as Computer",
        "'Security' as Channel",
        "if(status = 401, null, event_id) as RecordID",
        "concat('rule-', status) as AlertName",
    )


def ip_responses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "concat('10.0.', (c_custkey div 250) % 256, '.', c_custkey % 250 + 1) as ip",
        "concat('{\"data\":{\"abuseConfidenceScore\":', if(c_nationkey = 3, 'null', cast(c_custkey % 101 as string)), "
        "',\"countryCode\":\"', if(c_nationkey = 5, '', concat('N', c_nationkey)), '\",\"isp\":\"', c_mktsegment, "
        "'\",\"totalReports\":', c_custkey % 7, '}}') as payload",
        "c_mktsegment",
    )


def scan_responses(spark: SparkSession, sf: str) -> DataFrame:
    labelled = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    counted = labelled.groupBy(F.sha2("text", 256).alias("hash")).agg(
        F.sum("toxic").alias("toxic"), F.sum("quality").alias("quality"), F.count(F.lit(1)).alias("n")
    )
    return counted.selectExpr(
        "hash",
        "concat('{\"last_analysis_stats\":{\"malicious\":', toxic, ',\"harmless\":', quality, ',\"undetected\":', n, "
        "',\"type-unsupported\":', n, '}}') as payload",
    )


def report_responses(spark: SparkSession, sf: str) -> DataFrame:
    body = (
        "concat('{\"title\":\"Case ', conv_id, '-', turn, '\",\"summary\":\"', length(text), ' chars\",\"severity\":\"', "
        "case role when 'user' then 'Low' when 'assistant' then 'Medium' else 'High' end, "
        "'\",\"timeline\":[{\"time\":\"t', turn, '\",\"event_count\":3},\"noise\"],"
        "\"mitre_mappings\":[{\"technique\":\"T', 1000 + conv_id, '\",\"name\":\"', role, '\"},{\"tactic\":\"x\"}],"
        "\"mitigation\":{\"format\":\"', if(turn % 2 = 0, 'Sigma', 'YARA'), '\",\"content\":\"rule ', conv_id, '\"},"
        "\"indicators\":[{\"description\":\"d', turn, '\",\"evidence\":{\"n\":', turn, '}}],\"extra\":1', "
        "if(conv_id % 10 = 9, '', '}'))"
    )
    return table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "role",
        f"if(turn % 2 = 0, concat('Here it is:\\n```json\\n', {body}, '\\n```\\n'), "
        f"if(turn % 7 = 3, concat('{{\"title\":\"only ', conv_id, '\"}}'), {body})) as text",
    )


# --- SQL ---------------------------------------------------------------------


def _file_lines(prefix: str, line: str) -> str:
    return (
        f"select '{prefix}-' || (user_id % 20) as file, event_id // 1000 as block, event_id as pos, {line} as line "
        "from web_events"
    )


def _duck_extract(patterns: dict[str, str], field: str, line: str = "line") -> str:
    return f"regexp_extract({line}, '{patterns[field]}', 1)" if field in patterns else "cast(null as varchar)"


def duck_fields(fmt: str, line: str = "line") -> dict[str, str]:
    """The four text fields of a line of a known format."""
    if fmt == "jsonline":
        event = f"regexp_extract({line}, '{C.JSON_EVENT}', 1)"
        return {
            "event_timestamp": f"coalesce(nullif(regexp_extract({line}, '{C.JSON_TIME_TEXT}', 1), ''), "
                               f"regexp_extract({line}, '{C.JSON_TIME_EPOCH}', 1))",
            "source_ip": f"regexp_extract({line}, '{C.JSON_ADDRESS}', 1)",
            "status_code": f"regexp_extract({line}, '{C.JSON_STATUS}', 1)",
            "event_type": f"regexp_extract({event}, '{C.JSON_EVENT_WORD}', 1)",
        }
    patterns = C.WEB_FIELDS if fmt == "web" else C.SYSLOG_FIELDS
    return {f: _duck_extract(patterns, f, line) for f in extract.FIELDS}


def duck_time(col: str) -> str:
    return (
        f"cast(coalesce(try_strptime({col}, '%d/%b/%Y:%H:%M:%S %z') at time zone 'UTC', "
        f"try_strptime({col}, '%Y-%m-%dT%H:%M:%S%z') at time zone 'UTC', "
        f"try_strptime({col}, '%b %d %H:%M:%S'), try_strptime({col}, '%Y-%m-%d %H:%M:%S'), "
        f"try_cast({col} as timestamptz) at time zone 'UTC', "
        f"to_timestamp(try_cast({col} as bigint)) at time zone 'UTC') as timestamp)"
    )


def _select_fields(fmt: str) -> str:
    return ", ".join(f"{sql} as {f}" for f, sql in duck_fields(fmt).items())


_SQL_IP = "'10.0.' || ((user_id // 250) % 256) || '.' || (user_id % 250 + 1)"
_SQL_RECORD_MESSAGE = (
    "case when event_type = 'view' then '{\"EventData_Tags\": [\"' || event_type || '\", \"beta\"], ' "
    "else '{\"EventData_Data_IpAddress\": \"' || ip || '\", \"EventData_Data_StatusCode\": ' || status || ', ' end || "
    "'\"System_Channel\": \"Security\", \"System_Computer\": \"HOST-' || (user_id % 20) || '\", \"System_EventID\": ' || "
    "(4600 + event_id % 50) || ', \"System_Level\": 0, \"System_Load\": 1.0, \"System_Mix\": [{\"a\": [2.5, \"x\"], \"z\": 1}], "
    "\"System_Provider_Name\": \"Audit\", \"System_Ratio\": 1e+22, \"System_Task\": 12544, "
    "\"System_TimeCreated_SystemTime\": \"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z\", \"System_b_c\": ' || (2 - event_id % 2) || "
    "case when event_id % 10 = 0 then ', \"System_d1_d2_d3_d4_d5_d6_d7_d8_d9\": ' || event_id else '' end || '}'"
)

# name -> (relations it reads, SQL)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "web_events": ((), (
        f"select event_id, ts, user_id, event_type, value, {_SQL_IP} as ip, cast({_STATUS} as integer) as status, "
        f"{_METHOD} as method from events"
    )),
    "access_lines": (("web_events",), _file_lines("web", (
        "ip || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] \"' || method || ' /' || event_type || '/' || "
        "event_id || ' HTTP/1.1\" ' || status || ' ' || user_id"
    ))),
    "syslog_lines": (("web_events",), _file_lines("sys", (
        "strftime(ts, '%b %d %H:%M:%S') || ' srv-' || (user_id % 20) || ' ' || event_type || 'd[' || event_id || "
        "']: Failed login' || case when event_id % 2 = 0 then ' from ' || ip else '' end || ' port 22'"
    ))),
    "json_lines": (("web_events",), _file_lines("app", (
        "'{\"ts\":' || case when event_id % 2 = 1 then cast(cast(floor(epoch(ts)) as bigint) as varchar) else "
        "'\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z\"' end || ',\"component\":\"' || event_type || "
        "'\",\"src_ip\":\"' || ip || '\",\"status\":' || status || '}'"
    ))),
    "unclear_lines": (("web_events",), _file_lines("amb", (
        "'[' || strftime(ts, '%H:%M:%S') || '] heartbeat OK code=' || status || ' len=' || event_id"
    ))),
    "empty_json_lines": (("web_events",), _file_lines("nul", "'{\"time\":null,\"k\":\"' || event_type || '\"}'")),
    "mixed_lines": (
        ("access_lines", "syslog_lines", "json_lines", "unclear_lines", "empty_json_lines"),
        "select * from access_lines union all select * from syslog_lines union all select * from json_lines "
        "union all select * from unclear_lines union all select * from empty_json_lines",
    ),
    "web_fields": (("access_lines",), f"select {_select_fields('web')}, line as raw_message from access_lines"),
    "unified_events": (("web_fields",), (
        f"select {duck_time('event_timestamp')} as event_timestamp, source_ip, event_type, "
        "try_cast(status_code as integer) as status_code, raw_message, cast(null as varchar) as process_name, "
        "cast(null as varchar) as destination_ip from web_fields"
    )),
    "network_events": ((), (
        "select l_shipdate as event_timestamp, '10.1.' || ((l_suppkey // 250) % 256) || '.' || (l_suppkey % 250 + 1) as source_ip, "
        "case when l_linenumber <= 5 then 'Network Connection' else 'Process Create' end as event_type, "
        "cast(null as integer) as status_code, cast(null as varchar) as raw_message, "
        "case when l_partkey % 97 = 0 then null else 'proc_' || (l_partkey % 400) || '.exe' end as process_name, "
        "'198.51.100.' || (l_suppkey % 250 + 1) as destination_ip from lineitem"
    )),
    "all_events": (("unified_events", "network_events"),
                   "select * from unified_events union all select * from network_events"),
    "netset_lines": ((), (
        "select lower(c_mktsegment) as list_name, case c_nationkey when 7 then '# ' || c_name when 11 then 'not-a-cidr' "
        "when 13 then '   ' else '  10.0.' || ((c_custkey // 250) % 256) || '.' || (c_custkey % 250) || '/' || "
        "(20 + c_custkey % 13) || ' ' end as line from customer"
    )),
    "netset": (("netset_lines",), (
        "select list_name, trim(line) as cidr from netset_lines where trim(line) <> '' and trim(line) not like '#%'"
    )),
    "networks": (("netset",), (
        "select list_name, cidr, cast(regexp_extract(cidr, '/(\\d+)$', 1) as integer) as prefix_len, "
        "cast(split_part(cidr, '.', 1) as bigint) * 16777216 + cast(split_part(cidr, '.', 2) as bigint) * 65536 + "
        "cast(split_part(cidr, '.', 3) as bigint) * 256 + "
        "cast(split_part(split_part(cidr, '.', 4), '/', 1) as bigint) as num "
        "from netset where regexp_matches(cidr, '^\\d+\\.\\d+\\.\\d+\\.\\d+/\\d+$')"
    )),
    "ip_hits": (("web_events", "networks"), (
        "select ip, string_agg(list_name, ', ' order by list_name) as threat_lists from ("
        "select distinct i.ip, n.list_name from (select ip, cast(split_part(ip, '.', 1) as bigint) * 16777216 + "
        "cast(split_part(ip, '.', 2) as bigint) * 65536 + cast(split_part(ip, '.', 3) as bigint) * 256 + "
        "cast(split_part(ip, '.', 4) as bigint) as num from (select distinct ip from web_events)) i "
        "join networks n on (i.num >> (32 - n.prefix_len)) = (n.num >> (32 - n.prefix_len))) group by ip"
    )),
    "allowlist": ((), (
        "select 'entry-' || c_custkey as id, '10.0.' || ((c_custkey // 250) % 256) || '.' || (c_custkey % 250 + 1) as indicator, "
        "case when c_mktsegment = 'MACHINERY' then 'hash' else 'ip' end as indicator_type, c_name as description, "
        "'{\"nation\":' || c_nationkey || '}' as metadata, "
        "timestamp '2024-01-01 00:00:00' + to_minutes(cast(c_custkey as integer)) as created_at "
        "from customer where c_mktsegment in ('BUILDING', 'MACHINERY')"
    )),
    "documents_as_files": ((), (
        "select '/in/' || source || '/doc' || lpad(cast(doc_id as varchar), 12, '0') || "
        "case lang when 'de' then '.CSV' when 'es' then '.evtx' when 'fr' then '.log' else '' end as path, "
        "cast(octet_length(encode(text)) as bigint) as length, substring(text, 1, 4096) as head, "
        "sha256(text) as content_key from documents"
    )),
    "document_files": ((), (
        f"select {_PATH.format(text='varchar')} as path, case when doc_id % 37 = 0 then 0 else octet_length(encode(coalesce(text, ''))) "
        "+ case when doc_id % 41 = 0 then 3 else 0 end end as length, case when doc_id % 41 <> 0 then substring(coalesce(text, ''), 1, 4096) end as head, "
        "case when doc_id % 37 = 0 or coalesce(text, '') = '' and doc_id % 41 <> 0 then '' else (doc_id % 41 = 0) || sha256(coalesce(text, '')) end as content_key from documents"
    )),
    "document_ips": ((), (
        "select doc_id, unnest(regexp_extract_all(text, '([0-9]{1,3}(?:\\.[0-9]{1,3}){3})', 1)) as source_ip from documents"
    )),
    "record_rows": (("web_events",), (
        "select strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as timestamp, cast(4600 + event_id % 50 as varchar) as event, "
        f"{_SQL_RECORD_MESSAGE} as message, cast(event_id as varchar) as record_id, "
        "case when event_type <> 'view' then ip end as source_ip, "
        "case when event_type <> 'view' then cast(status as varchar) end as status_code, 'Audit' as provider, "
        "'Security' as channel, 'HOST-' || (user_id % 20) as computer, '0' as level, '12544' as task from web_events"
    )),
    "alerts": (("web_events",), (
        "select strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' as \"Timestamp\", 'HOST-' || (user_id % 20) as \"Computer\", "
        "'Security' as \"Channel\", case when status = 401 then null else event_id end as \"RecordID\", "
        "'rule-' || status as \"AlertName\" from web_events where event_type = 'error'"
    )),
    "ip_reputation": ((), (
        "select '10.0.' || ((c_custkey // 250) % 256) || '.' || (c_custkey % 250 + 1) as ip, "
        "cast(case when c_nationkey = 3 then 0 else c_custkey % 101 end as integer) as abuse_confidence_score, "
        "case when c_nationkey = 5 then null else 'N' || c_nationkey end as country_code, c_mktsegment as isp, "
        "cast(null as varchar) as domain, cast(c_custkey % 7 as integer) as total_reports, "
        "cast(null as varchar) as last_reported_at, c_mktsegment from customer"
    )),
    "hash_reputation": ((), (
        "select hash, cast(toxic as bigint) as malicious, cast(0 as bigint) as suspicious, cast(n as bigint) as undetected, "
        "cast(quality as bigint) as harmless, case when toxic + quality + 2 * n = 0 then 0.0 else "
        "cast(toxic as double) / cast(toxic + quality + 2 * n as double) end as detection_ratio from ("
        "select sha256(text) as hash, sum(toxic) as toxic, sum(quality) as quality, count(*) as n "
        "from labels join documents using (doc_id) group by 1)"
    )),
    "responses": ((), (
        "select conv_id, turn, role, 'Case ' || conv_id || '-' || turn as title, length(text) || ' chars' as summary, "
        "case role when 'user' then 'Low' when 'assistant' then 'Medium' else 'High' end as severity, "
        "case when turn % 2 <> 0 and turn % 7 = 3 then 'missing: mitigation, mitre_mappings, severity, summary, timeline' "
        "when conv_id % 10 = 9 then 'invalid_json' else 'ok' end as status, "
        "case when turn % 2 = 0 then 'Sigma' else 'YARA' end as rule_format from conversations"
    )),
}


_CASES = {
    f: "case format " + " ".join(f"when '{fmt}' then {duck_fields(fmt)[f]}" for fmt in extract.TEXT_FORMATS) + " end"
    for f in extract.FIELDS
}
SQL["file_formats"] = (("mixed_lines",), (
    "select file, case "
    f"when bool_or(regexp_matches(line, '{C.DETECT_WEB_ADDRESS}')) and "
    f"bool_or(regexp_matches(line, '{C.DETECT_WEB_REQUEST}')) then 'web' "
    f"when bool_or(regexp_matches(line, '{C.DETECT_SYSLOG}')) then 'syslog' "
    f"when bool_or(regexp_matches(line, '{C.DETECT_JSON}')) then 'jsonline' else 'ambiguous' end as format "
    "from (select * from mixed_lines qualify row_number() over (partition by file order by block, pos) <= 20) "
    "group by file"
))
SQL["extracted_lines"] = (("mixed_lines", "file_formats"), (
    "select *, count(*) filter (where coalesce(event_timestamp, '') <> '' or coalesce(source_ip, '') <> '' "
    "or coalesce(event_type, '') <> '') over (partition by file) as hits from (select file, format, line, "
    + ", ".join(f"{sql} as {f}" for f, sql in _CASES.items())
    + " from mixed_lines join file_formats using (file))"
))
SQL["structured_lines"] = (("extracted_lines",), (
    "select file, case when hits > 0 then format else 'raw' end as format, hits > 0 as structured, "
    + ", ".join(f"case when hits > 0 then {f} end as {f}" for f in extract.FIELDS)
    + ", line as raw_message from extracted_lines"
))


def with_relations(names: tuple[str, ...] | list[str], body: str) -> str:
    """``body`` preceded by the named relations and all they depend on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dependency in SQL[name][0]:
            add(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} as ({SQL[n][1]})" for n in ordered)
    return f"with {ctes}\n{body}"
