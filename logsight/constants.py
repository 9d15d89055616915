"""Fixed values, thresholds and schemas.

Everything in the ``FIXED VALUES`` block must equal the behaviour we
reproduce (token lists, alias table, severity tables, line patterns,
thresholds); it is stated once, plainly, in natural order. Regular
expressions are written in Java syntax with positional groups because
Spark's ``regexp_extract`` addresses groups by index.
"""
from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must match the reference behaviour exactly.
# ---------------------------------------------------------------------------

# Canonical event columns, in output order.
CANONICAL_COLUMNS = [
    "row_id", "timestamp", "src_ip", "dst_ip", "dst_port",
    "username", "event", "bytes", "duration", "status", "label_original",
]

# Header aliases per canonical column. Keys are compared after lower-casing,
# trimming and squashing runs of space/underscore/dot/hyphen to one space.
# Dict order and list order both matter: first hit wins.
COLUMN_ALIASES: dict[str, list[str]] = {
    "timestamp": ["timestamp", "time", "datetime", "date", "date/time", "@timestamp", "ts", "eventtime",
                  "event time", "date time", "start time", "record time"],
    "src_ip": ["src ip", "source ip", "srcip", "source address", "sourceaddress", "client ip",
               "clientip", "remote addr", "remoteaddr", "src addr", "srcaddr", "ip", "source"],
    "dst_ip": ["dst ip", "dest ip", "destination ip", "dstip", "destination address",
               "destinationaddress", "dst addr", "dstaddr", "server ip"],
    "dst_port": ["dst port", "dest port", "destination port", "dstport", "dport", "port"],
    "username": ["username", "user name", "user", "account", "login", "loginname", "authuser"],
    "event": ["event", "message", "msg", "description", "details", "info", "log", "text",
              "request", "uri", "url", "path", "query", "alert", "signature",
              "log message", "log line", "event description"],
    "bytes": ["bytes", "total bytes", "totalbytes", "length", "size", "flow bytes",
              "flowbytes", "content length", "responselen", "response length"],
    "duration": ["duration", "flow duration", "flowduration", "elapsed", "elapsed time"],
    "status": ["status", "status code", "statuscode", "http status", "response code",
               "responsecode", "result", "outcome"],
    "label_original": ["label", "class", "attack", "attack cat", "attackcat", "attack type",
                       "attacktype", "category", "type"],
}

# Literal (non-regex) substring tokens searched in the cleaned event text.
FAIL_WORDS = ("failed", "failure", "denied", "invalid", "unauthorized",
              "unauthorised", "authentication error", "401", "403")
SQL_TOKENS = ("'", "union select", "or 1=1", "1=1", "--", ";drop", "sleep(",
              "information_schema")
PRIV_TOKENS = ("sudo", "su -", "setuid", "chmod 777", "/etc/shadow",
               "/etc/passwd", "whoami /priv", "uac", "privilege",
               "administrators", "wheel group", "root group")
MALWARE_TOKENS = ("powershell -enc", "powershell -e ", "-enc ", "base64",
                  "mimikatz", "temp\\", "/tmp/", ".exe", "ransom", "beacon",
                  "c2", "trojan", "reverse shell", "vssadmin", "shadow copy")

# Analysis thresholds.
CONFIDENCE_ANOMALY_THRESHOLD = 0.55   # attack below this is kept as Normal
LOW_CONFIDENCE_NOTE = 0.65            # severity one level down below this
HIGH_CONFIDENCE_NOTE = 0.90           # severity one level up at/above this
SEVERITY_REPEAT_IP_THRESHOLD = 20     # attack rows per IP that bump severity
RATE_WINDOW_SECONDS = 30              # +/- seconds for ip_rate_1min
SERVICE_PORT_LIMIT = 49152            # ports below this are "service" ports
TOP_DETECTIONS = 25
TOP_K = 5
PAGE_SIZE = 25
EPOCH_MIN, EPOCH_MAX = 1e9, 1e11

# Severity: ordered levels and base level per attack category (default Low).
SEVERITY_LEVELS = ["Low", "Medium", "High", "Critical"]
BASE_SEVERITY = {
    "Malware Activity": "Critical",
    "SQL Injection": "High",
    "Privilege Escalation": "High",
    "DoS Indicators": "High",
    "Brute Force": "Medium",
    "Port Scan": "Low",
}
ATTACK_CATEGORIES = [
    "Brute Force",
    "Port Scan",
    "Malware Activity",
    "SQL Injection",
    "Privilege Escalation",
    "DoS Indicators",
]
NORMAL_LABEL = "Normal"

# Model inputs.
MODEL_NUMERIC_FEATURES = [
    "bytes", "duration", "dst_port",
    "ip_event_count", "ip_rate_1min", "ip_unique_ports",
    "ip_fail_ratio", "ip_unique_users",
    "event_length", "has_sql_tokens", "has_priv_tokens", "has_malware_tokens",
]
TEXT_FEATURE = "event_clean"

# Text that a reader takes for a missing value.
NULL_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Admission limits.
ALLOWED_EXTENSIONS = (".csv", ".xlsx", ".log")
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
MAX_XLSX_DECOMPRESSED = 200 * 1024 * 1024
BINARY_HEAD_BYTES = 8192
NON_PRINTABLE_RATIO_LIMIT = 0.10

# Log line patterns (Java regex; group numbers noted).
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
IPV4_RE = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
# 1 method, 2 url
URL_RE = r'"([A-Z]+)\s+(\S+)\s+[^"]*"'
# 1 ts, 2 host, 3 prog, 4 msg
SYSLOG_RE = (r"^((?:" + MONTHS + r")\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
             r"([\w\-.]+)(?:\[\d+\])?:\s*(.*)$")
# 1 ip, 2 user, 3 ts, 4 request, 5 status, 6 size, 7 referrer, 8 agent
APACHE_RE = (r"^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"
             r'"([^"]*)"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?')
# 1 ts, 2 level, 3 rest
ISO_RE = (r"^(\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s*"
          r"(?:(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|NOTICE|FATAL)\s+)?(.*)$")
APACHE_PORT_RE = r":(\d{1,5})(?:/\S*)?\s+HTTP"
SYSLOG_PORT_RE = r"\bport (\d{1,5})\b"
SYSLOG_FOR_USER_RE = r"\bfor (?:invalid user |user )?(\w[\w.@-]{0,63})"
SYSLOG_FOR_USER_EXCLUDED = ("from", "port", "invalid", "user")
INVALID_USER_RE = r"(?i)invalid user (\S+)"
GENERIC_USER_RE = r"(?i)\buser[=:\s]+(\w[\w.@-]{0,63})"
# Generic timestamp search, tried in this order.
GENERIC_TS_RES = (
    r"\b\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b",
    r"\b(?:" + MONTHS + r")\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b",
    r"\b\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4}\b",
    r"\b\d{10}(?:\.\d+)?\b",
)
# key=value extraction: (field, pattern with the value in group 1).
KV_PATTERNS = (
    ("src_ip", r"\b(?:src|src_ip|source_ip|source|client|client_ip|remote)[:=]\s*(\d{1,3}(?:\.\d{1,3}){3})"),
    ("dst_ip", r"\b(?:dst|dst_ip|dest_ip|dest|server)[:=]\s*(\d{1,3}(?:\.\d{1,3}){3})"),
    ("dst_port", r"\b(?:dport|dst_port|dest_port|port)[:=]\s*(\d{1,5})"),
    ("bytes", r"\b(?:bytes|size|len|length)[:=]\s*(\d{1,12})"),
    ("duration", r"\b(?:duration|elapsed)[:=]\s*([\d.]{1,12})"),
    ("status", r"\b(?:status|code)[:=]\s*(\d{3})"),
)
KV_USER_RE = r"\b(?:user|username|account|login)[:=]\s*([\w.@-]{1,64})"
# Literal substrings without which a key=value pattern cannot match (a cheap
# guard run before the regex).
KV_KEYWORDS = {
    "src_ip": ("src", "source", "client", "remote"),
    "dst_ip": ("dst", "dest", "server"),
    "dst_port": ("port",),
    "bytes": ("bytes", "size", "len"),
    "duration": ("duration", "elapsed"),
    "status": ("status", "code"),
    "username": ("user", "account", "login"),
}

# Timestamp routes.
NOYEAR_TS_RE = r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}$"
APACHE_TS_RE = r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4}$"

# Legacy generation: static severity per category (unknown -> Medium).
LEGACY_SEVERITY = {
    "Normal": "Low",
    "Brute Force": "High",
    "Port Scan": "Medium",
    "Malware Activity": "Critical",
    "SQL Injection": "High",
    "Privilege Escalation": "Critical",
    "DoS Indicators": "High",
}
LEGACY_SEVERITY_DEFAULT = "Medium"
# Legacy line patterns (Java regex).
LEGACY_TS_RE = (r"(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?|"
                r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}[+-]\d{4}|"
                r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}|"
                r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})")
LEGACY_USER_RE = (r"(?:user|username|login|account)[\s:=]+([a-zA-Z0-9._-]+)|"
                  r"(?:for|from)\s+([a-zA-Z0-9._-]+)\s+(?:from|at|\(|$)")
LEGACY_EVENT_RE = (r"(?i)(?:error|fail|warning|info|debug|critical|alert|notice|emergency|"
                   r"attack|intrusion|breach|scan|brute|force|injection|malware|dos|ddos|"
                   r"privilege|escalation|port|unauthorized|access|denied|blocked|suspicious|anomaly)")
LEGACY_ATTACK_KEYWORDS = [
    "attack", "intrusion", "breach", "scan", "brute", "force",
    "injection", "malware", "dos", "ddos", "privilege", "escalation",
    "unauthorized", "denied", "blocked", "suspicious", "anomaly",
]
# Legacy explicit timestamp formats, tried in order (Spark datetime patterns).
LEGACY_TS_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX",
    "yyyy-MM-dd'T'HH:mm:ssXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "dd/MMM/yyyy:HH:mm:ss Z",
    "MMM dd HH:mm:ss",
]
