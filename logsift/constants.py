"""Values every stage shares.

Fixed values: the names, patterns, thresholds and texts below define the data
contract. They must stay as they are for results to be comparable.
"""

# Unified events schema: column name -> Spark SQL type.
EVENT_TYPES = {
    "event_timestamp": "timestamp_ntz",
    "source_ip": "string",
    "event_type": "string",
    "status_code": "int",
    "raw_message": "string",
    "process_name": "string",
    "destination_ip": "string",
}
EVENT_COLUMNS = tuple(EVENT_TYPES)

# Source column names accepted for each unified column, in priority order.
FIELD_ALIASES = {
    "event_timestamp": [
        "timestamp", "event_timestamp", "time", "date", "ts", "datetime", "event_time", "created_at",
    ],
    "source_ip": ["client_ip", "remote_addr", "src_ip", "source_ip", "ip", "remote_ip", "client"],
    "event_type": ["event", "event_type", "action", "method", "request_method", "type"],
    "status_code": ["status", "status_code", "http_status", "response_code", "code"],
    "raw_message": ["message", "raw_message", "line", "log", "raw"],
    "process_name": ["process_name", "process", "proc", "executable", "exe", "image"],
    "destination_ip": ["destination_ip", "dest_ip", "dst_ip", "destination", "destination_address"],
}

# Line shapes that decide the format of a text file (web needs both patterns).
DETECT_LINES = 20
DETECT_WEB_ADDRESS = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
DETECT_WEB_REQUEST = r'\[.*?\] "\w+ '
DETECT_SYSLOG = r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
DETECT_JSON = (
    r'^\s*\{.*"(?:ts|timestamp|time|time_iso8601|time_local|remote_ip|remote_addr|request|response)"\s*:'
)

# Field patterns per text format; group 1 is the value.
WEB_FIELDS = {
    "event_timestamp": r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+\-]\d{4})\]",
    "source_ip": r"^([0-9]{1,3}(?:\.[0-9]{1,3}){3})",
    "status_code": r'"\s+(\d{3})\s+',
    "event_type": r'"(\w+)\s+\S+\s+HTTP',
}
SYSLOG_FIELDS = {
    "event_timestamp": r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})",
    "source_ip": r"(?:from\s+)([0-9]{1,3}(?:\.[0-9]{1,3}){3})",
    "event_type": r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+([A-Za-z0-9_.-]+)(?:\[\d+\])?:",
}
JSON_TIME_TEXT = r'"(?:ts|timestamp|time|time_iso8601|time_local)"\s*:\s*"([^"]+)"'
JSON_TIME_EPOCH = r'"(?:ts|timestamp|time|time_iso8601|time_local)"\s*:\s*(\d+)'
JSON_ADDRESS = r'"(?:src_ip|source_ip|ip|remote_ip|remote_addr)"\s*:\s*"([^"]+)"'
JSON_STATUS = r'"(?:status|status_code|response)"\s*:\s*(\d+)'
JSON_EVENT = r'"(?:component|event_type|event|method|request)"\s*:\s*"([^"]+)"'
JSON_EVENT_WORD = r"(\w+)"

# Looser patterns used only to profile how much of a text a format explains.
PROFILE_FIELDS = {
    "web": {
        "timestamp": r"(?i)\[([^\]]+)\]",
        "source_ip": r"^([0-9]{1,3}(?:\.[0-9]{1,3}){3})",
        "status_code": r'(?i)"\s+(\d{3})\s+',
        "event_type": r'(?i)"(\w+)\s+\S+\s+HTTP',
    },
    "syslog": {
        "timestamp": r"(?i)^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})",
        "source_ip": r"(?i)(?:from\s+)([0-9]{1,3}(?:\.[0-9]{1,3}){3})",
        "event_type": r"(?i)\s+(\w+?)(?:\[\d+\])?:",
    },
    "jsonlog": {
        "timestamp": r'(?i)"ts"\s*:\s*"([^"]+)"',
        "source_ip": r'(?i)"src_ip"\s*:\s*"([^"]+)"',
        "status_code": r'(?i)"status"\s*:\s*(\d+)',
        "event_type": r'(?i)"component"\s*:\s*"([^"]+)"',
    },
    "ambiguous": {
        "timestamp": r"\[(\d{2}:\d{2}:\d{2})\]",
        "source_ip": r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})",
        "status_code": r"code=(\d+)",
    },
}

# Windows-event rows: output columns and, per value, the flattened keys tried in order.
RECORD_COLUMNS = (
    "timestamp", "event", "message", "record_id", "source_ip", "status_code",
    "provider", "channel", "computer", "level", "task",
)
RECORD_TIME_KEYS = ("System_TimeCreated_SystemTime", "TimeCreated_SystemTime", "timestamp")
RECORD_EVENT_KEYS = ("System_EventID", "EventID")
RECORD_ADDRESS_KEYS = (
    "EventData_Data_IpAddress", "System_EventData_Data_IpAddress", "System_EventData_IpAddress",
    "EventData_IpAddress", "IpAddress", "ClientIpAddress", "SourceIp",
)
RECORD_STATUS_KEYS = (
    "EventData_Data_StatusCode", "System_EventData_Data_StatusCode", "System_EventData_StatusCode",
    "EventData_StatusCode", "StatusCode", "Status",
)
RECORD_PLAIN_KEYS = {
    "provider": "System_Provider_Name",
    "channel": "System_Channel",
    "computer": "System_Computer",
    "level": "System_Level",
    "task": "System_Task",
}

# Files.
FORMAT_BY_SUFFIX = {".csv": "csv", ".json": "json", ".txt": "txt", ".log": "log", ".evtx": "evtx"}
SUPPORTED_FORMATS = ("csv", "json", "txt", "log", "evtx")
SNIFF_BYTES = 4096
PREVIEW_LINES = 200
PREVIEW_BYTES = 64 * 1024
PREVIEW_ROWS = 100
LARGE_FILE_BYTES = 100 * 1024 * 1024
INGEST_STATUSES = ("ready", "pending", "ingested", "invalid", "error")

# Anomaly templates and severity scoring.
BUCKET_WIDTH = "5 minutes"
NETWORK_EVENT = "Network Connection"
SEQUENCE_SEPARATOR = " → "
ERROR_STATUS = 400
SEVERITY_THRESHOLDS = {
    "top_talkers": 100,
    "error_spikes": 50,
    "event_distribution": 100,
    "temporal_anomaly": 100,
    "long_tail_analysis": 2,
    "source_ip_sequence": 50,
}
SEVERITIES = ("Low", "Medium", "High")

# Timeline.
TIMELINE_LIMIT = 500
RECENT_EVENTS = 10
MESSAGE_CHARS = 80
STATUS_PRESETS = {"All": None, ">= 3xx": 300, ">= 4xx": 400, ">= 5xx": 500}

# Report context and reports.
EVIDENCE_CHARS = 500
SAMPLE_EVENTS = 10
SAMPLE_CHARS = 1000
REPORT_FIELDS = ("title", "summary", "severity", "timeline", "mitre_mappings", "mitigation")
RULE_EXTENSIONS = {"sigma": "yml", "yara": "yar", "spl": "spl"}
SCAN_CATEGORIES = (
    "malicious", "suspicious", "undetected", "harmless",
    "confirmed-timeout", "failure", "timeout", "type-unsupported",
)

# Fixed values of the data contract: messages.
FILE_NOT_FOUND = "Log file not found: "
FILE_EMPTY = "Log file is empty: "
FILE_BINARY = "Unsupported binary file format for "
RULE_FORMAT_MISMATCH = "Requested format '{wanted}' does not match report mitigation format '"
