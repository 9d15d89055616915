"""DuckDB SQL building blocks for the oracle twins of the catalogue queries.

The oracle re-derives every fixture and rule independently in SQL over the
same driver tables; patterns come from ``constants`` (RE2 accepts them once
the Java-only ``(?U)`` flag is dropped).
"""
from __future__ import annotations

from logsight import constants as C


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return q(pattern.replace("(?U)", ""))


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def first_sql(expr: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({expr}, {rx(pattern)}, {group}), '')"


def any_token_sql(expr: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(t)})" for t in tokens) + ")"


SEC_SQL = "1786320000 + CAST(floor(epoch(ts)) AS BIGINT) // 300 - 5680000"
TS_SQL = "make_timestamp(sec * 1000000)"


def fmt_sec(expr: str, fmt: str = "%Y-%m-%d %H:%M:%S") -> str:
    return f"strftime(make_timestamp(({expr}) * 1000000), {q(fmt)})"


LINES_CTE = f"""lines_c AS (
  SELECT event_id AS row_id, event_type, value, user_id, {SEC_SQL} AS sec,
         concat('10.0.', CAST(user_id % 3 AS VARCHAR), '.', CAST(10 + user_id % 12 AS VARCHAR)) AS ip,
         CAST(20 + (event_id * 37) % 60000 AS BIGINT) AS port,
         concat('user', CAST(user_id % 20 AS VARCHAR)) AS usr
  FROM events),
lines_m AS (SELECT *, CASE event_type
    WHEN 'error'    THEN concat('Failed password for ', usr, ' from ', ip, ' port ', CAST(port AS VARCHAR), ' ssh2')
    WHEN 'signup'   THEN concat('Invalid user ', usr, ' from ', ip, ' port ', CAST(port AS VARCHAR))
    WHEN 'purchase' THEN concat('query id=1%27%20OR%201=1-- src=', ip, ' user=', usr)
    WHEN 'click'    THEN concat('sudo COMMAND=/bin/sh user=', usr, ' src=', ip, ' bytes=', CAST(port AS VARCHAR))
    ELSE concat('Accepted password for ', usr, ' from ', ip, ' port 22 ssh2') END AS msg,
  {TS_SQL} AS tsx FROM lines_c),
lines AS (
  SELECT unnest(CASE WHEN row_id % 10 = 0 THEN [row_id, row_id + 10000000000] ELSE [row_id] END) AS row_id, CASE
    WHEN row_id % 8 = 7 THEN concat('maintenance note by ', usr, ' on shelf ', CAST(user_id % 9 AS VARCHAR))
    WHEN row_id % 40 = 6 THEN concat(strftime(tsx, '%Y-%m-%d %H:%M:%S'), ' ERROR powershell -enc ZQBj drops mimikatz src=', ip,
         ' dst=10.9.9.', CAST(user_id % 20 AS VARCHAR), ' dport=443 duration=1.5 status=503 len=88 user=', usr)
    WHEN row_id % 40 = 9 THEN concat(ip, ' - - [', strftime(tsx, '%d/%b/%Y:%H:%M:%S'), ' +0000] "CONNECT proxy:',
         CAST(8000 + user_id % 50 AS VARCHAR), '/x HTTP/1.1" 502 -')
    WHEN row_id % 60 = 10 THEN concat('2026-13-45 10:00:00 WARN ', msg)
    ELSE CASE row_id % 4
    WHEN 0 THEN concat(strftime(tsx, '%b %d %H:%M:%S'), ' host', CAST(user_id % 5 AS VARCHAR), ' sshd[',
                       CAST(100 + user_id AS VARCHAR), ']: ', msg)
    WHEN 1 THEN concat(ip, ' - ', CASE WHEN event_type = 'click' THEN usr ELSE '-' END, ' [',
                       strftime(tsx, '%d/%b/%Y:%H:%M:%S'), ' +0000] "GET /', event_type,
                       '?id=', CAST(user_id AS VARCHAR), '%27 HTTP/1.1" ',
                       CASE WHEN event_type = 'error' THEN '403' ELSE '200' END, ' ', CAST(port AS VARCHAR))
    WHEN 2 THEN concat(strftime(tsx, '%Y-%m-%d %H:%M:%S'), ' WARN ', msg)
    ELSE concat('seen at ', CAST(sec AS VARCHAR), ' ', msg) END END AS value,
  CASE WHEN row_id % 40 = 6 THEN 'Malware Activity' WHEN row_id % 40 = 9 THEN 'DoS Indicators' ELSE CASE event_type WHEN 'error' THEN 'Brute Force' WHEN 'signup' THEN 'Port Scan'
    WHEN 'purchase' THEN 'SQL Injection' WHEN 'click' THEN 'Privilege Escalation'
    ELSE 'Normal' END END AS label
  FROM lines_m)"""

SCORED_CTE = f"""sc AS (
  SELECT event_id AS row_id, {SEC_SQL} AS ts_sec,
    CASE WHEN event_id % 50 = 0 THEN 'unknown'
         ELSE concat('10.1.', CAST(user_id % 250 AS VARCHAR), '.', CAST(event_id % 2 AS VARCHAR)) END AS src_ip,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('user', CAST(user_id % 20 AS VARCHAR)) END AS username,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(20 + (event_id * 37) % 60000 AS INTEGER) END AS dst_port,
    CASE event_type WHEN 'error' THEN 'Brute Force' WHEN 'signup' THEN 'Port Scan'
      WHEN 'purchase' THEN 'SQL Injection'
      WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'Privilege Escalation'
                                          WHEN 1 THEN 'Malware Activity' ELSE 'DoS Indicators' END
      ELSE 'Normal' END AS raw_category,
    CAST(400 + (event_id * 7919) % 601 AS DOUBLE) / 1000 AS confidence,
    concat(event_type, ' event ', CAST(event_id AS VARCHAR), ' by user', CAST(user_id % 20 AS VARCHAR)) AS event,
    CAST(floor(epoch(ts)) AS BIGINT) AS event_sec
  FROM events)"""


def parsed_cte(source: str = "lines", id_col: str = "row_id", text_col: str = "value") -> str:
    """CTEs p0..parsed: the line parser over ``source``."""
    kv = dict(C.KV_PATTERNS)
    ap, sy, iso = rx(C.APACHE_RE), rx(C.SYSLOG_RE), rx(C.ISO_RE)
    gen_ts = "coalesce(" + ", ".join(f"nullif(regexp_extract(s, {rx(p)}, 0), '')" for p in C.GENERIC_TS_RES) + ")"

    def kvf(field, text="body"):
        return first_sql(text, kv[field])

    kv_user = first_sql("body", C.KV_USER_RE)
    for_user = first_sql("body", C.SYSLOG_FOR_USER_RE)
    excluded = ", ".join(q(x) for x in C.SYSLOG_FOR_USER_EXCLUDED)
    sy_base = f"coalesce({kv_user}, CASE WHEN lower({for_user}) NOT IN ({excluded}) THEN {for_user} END)"
    sy_user = (f"CASE WHEN contains(lower(body), 'invalid user') THEN {first_sql('body', C.INVALID_USER_RE)} "
               f"ELSE {sy_base} END")
    ipb = f"nullif(regexp_extract(body, {rx(C.IPV4_RE)}, 0), '')"
    cut = strip_sql("concat(substr(s, 1, instr(s, ts_raw) - 1), substr(s, instr(s, ts_raw) + length(ts_raw)))")
    return f"""p0 AS (SELECT {id_col} AS row_id, {strip_sql(text_col)} AS s FROM {source}),
p1 AS (SELECT *, CASE WHEN regexp_matches(s, {ap}) THEN 'apache' WHEN regexp_matches(s, {sy}) THEN 'syslog'
                      WHEN regexp_matches(s, {iso}) THEN 'iso' ELSE 'generic' END AS format
       FROM p0 WHERE s <> ''),
p2 AS (SELECT *,
  CASE format WHEN 'apache' THEN regexp_extract(s, {ap}, 3) WHEN 'syslog' THEN regexp_extract(s, {sy}, 1)
              WHEN 'iso' THEN regexp_extract(s, {iso}, 1) ELSE {gen_ts} END AS ts_raw,
  CASE format WHEN 'syslog' THEN regexp_extract(s, {sy}, 4) WHEN 'iso' THEN regexp_extract(s, {iso}, 3)
              WHEN 'generic' THEN s END AS body
  FROM p1),
p3 AS (SELECT row_id, format, ts_raw,
  CASE format WHEN 'apache' THEN regexp_extract(s, {ap}, 1)
              WHEN 'generic' THEN coalesce({ipb}, {kvf('src_ip')})
              ELSE coalesce({kvf('src_ip')}, {ipb}) END AS src_ip,
  {kvf('dst_ip')} AS dst_ip,
  TRY_CAST(CASE format WHEN 'apache' THEN {first_sql(f"regexp_extract(s, {ap}, 4)", C.APACHE_PORT_RE)}
              WHEN 'syslog' THEN coalesce({kvf('dst_port')}, {first_sql('body', C.SYSLOG_PORT_RE)})
              ELSE {kvf('dst_port')} END AS DOUBLE) AS dst_port,
  CASE format WHEN 'apache' THEN CASE WHEN regexp_extract(s, {ap}, 2) <> '-' THEN regexp_extract(s, {ap}, 2) END
              WHEN 'syslog' THEN {sy_user}
              WHEN 'iso' THEN {kv_user}
              ELSE coalesce({kv_user}, {first_sql('s', C.GENERIC_USER_RE)}) END AS username,
  CASE format WHEN 'apache' THEN CASE WHEN regexp_matches(s, {rx(C.URL_RE)})
                   THEN concat(regexp_extract(s, {rx(C.URL_RE)}, 1), ' ', regexp_extract(s, {rx(C.URL_RE)}, 2))
                   ELSE regexp_extract(s, {ap}, 4) END
              WHEN 'syslog' THEN concat(regexp_extract(s, {sy}, 3), ': ', body)
              WHEN 'iso' THEN body
              ELSE CASE WHEN ts_raw IS NULL OR {cut} = '' THEN s ELSE {cut} END END AS event,
  TRY_CAST(CASE format WHEN 'apache' THEN CASE WHEN regexp_full_match(regexp_extract(s, {ap}, 6), '[0-9]+')
                                           THEN regexp_extract(s, {ap}, 6) END
              ELSE {kvf('bytes')} END AS DOUBLE) AS bytes,
  TRY_CAST({kvf('duration')} AS DOUBLE) AS duration,
  CASE format WHEN 'apache' THEN regexp_extract(s, {ap}, 5) ELSE {kvf('status')} END AS status,
  CASE WHEN format = 'syslog' THEN regexp_extract(s, {sy}, 2) END AS host,
  CASE WHEN format = 'syslog' THEN regexp_extract(s, {sy}, 3) END AS prog
  FROM p2),
parsed AS (SELECT *, event IS NOT NULL AND (ts_raw IS NOT NULL OR src_ip IS NOT NULL) AS parse_ok FROM p3)"""


ISO_DIRECT_SQL = r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?$"


def ts_seconds_sql(raw: str, year: int) -> str:
    """Expression: raw timestamp text -> BIGINT seconds (same closed routes)."""
    x = strip_sql(f"coalesce({raw}, '')")
    sq = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    num = f"TRY_CAST({x} AS DOUBLE)"
    zoned = f"regexp_matches({x}, '(Z|[+-]\\d{{2}}(:?\\d{{2}})?)$') AND regexp_matches({x}, '\\d[T ]\\d')"
    dotted = f"replace({x}, ',', '.')"
    iso = (f"CASE WHEN {zoned} THEN epoch(TRY_CAST({dotted} AS TIMESTAMPTZ)) "
           f"ELSE epoch(TRY_CAST({dotted} AS TIMESTAMP)) END")
    return f"""CASE WHEN {x} = '' THEN NULL
  WHEN {num} BETWEEN {C.EPOCH_MIN} AND {C.EPOCH_MAX} THEN CAST(floor({num}) AS BIGINT)
  WHEN regexp_matches({x}, {rx(C.NOYEAR_TS_RE)})
    THEN CAST(floor(epoch(try_strptime(concat('{year} ', {sq}), '%Y %b %d %H:%M:%S'))) AS BIGINT)
  WHEN regexp_matches({x}, {rx(C.APACHE_TS_RE)})
    THEN CAST(floor(epoch(try_strptime({sq}, '%d/%b/%Y:%H:%M:%S %z'))) AS BIGINT)
  WHEN regexp_matches({x}, {q(ISO_DIRECT_SQL)}) THEN CAST(floor({iso}) AS BIGINT)
  WHEN regexp_matches({x}, '^\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}} \\d{{1,2}}:\\d{{2}}:\\d{{2}}$')
    THEN CAST(floor(epoch(try_strptime({x}, '%d %b %Y %H:%M:%S'))) AS BIGINT)
  END"""


def url_decode_sql(expr: str) -> str:
    return f"CASE WHEN contains({expr}, '%') THEN url_decode({expr}) ELSE {expr} END"


def clean_sql(expr: str) -> str:
    return f"regexp_replace(lower({expr}), '\\s+', ' ', 'g')"


def clean_events_cte(year: int = 2026) -> str:
    """CTE ``clean``: parsed fixture lines after dedupe/normalise/fill/text."""
    return f"""{LINES_CTE},
{parsed_cte()},
dd AS (SELECT *, row_number() OVER (
         PARTITION BY (ts_raw IS NOT NULL AND event IS NOT NULL), ts_raw, src_ip, event,
           CASE WHEN NOT (ts_raw IS NOT NULL AND event IS NOT NULL)
                THEN struct_pack(dst_ip := dst_ip, dst_port := dst_port, username := username, bytes := bytes,
                                 duration := duration, status := status) END
         ORDER BY row_id) AS _rn FROM parsed),
normed AS (SELECT *, {ts_seconds_sql('ts_raw', year)} AS ts_sec FROM dd WHERE _rn = 1),
filled AS (SELECT row_id, ts_raw, ts_sec, coalesce(src_ip, 'unknown') AS src_ip,
                  coalesce(dst_ip, 'unknown') AS dst_ip, dst_port, coalesce(username, '') AS username,
                  coalesce(event, '') AS event, bytes, duration, coalesce(status, '') AS status, format
           FROM normed),
clean AS (SELECT *, {clean_sql(url_decode_sql('event'))} AS event_clean FROM filled)"""


def features_cte(year: int = 2026) -> str:
    fail = any_token_sql("event_clean", C.FAIL_WORDS)
    return f"""{clean_events_cte(year)},
ipstat AS (SELECT src_ip, count(*) AS ip_event_count, count(DISTINCT dst_port) AS ip_unique_ports,
                  count(DISTINCT username) AS ip_unique_users,
                  avg(CASE WHEN {fail} THEN 1.0 ELSE 0.0 END) AS ip_fail_ratio
           FROM clean GROUP BY src_ip),
rated AS (SELECT *, CASE WHEN ts_sec IS NULL THEN 0 ELSE count(*) OVER (
             PARTITION BY src_ip, ts_sec IS NULL ORDER BY ts_sec
             RANGE BETWEEN {C.RATE_WINDOW_SECONDS} PRECEDING AND {C.RATE_WINDOW_SECONDS} FOLLOWING) END AS ip_rate_1min
          FROM clean),
feat AS (SELECT r.*, i.ip_event_count, i.ip_unique_ports, i.ip_unique_users, i.ip_fail_ratio,
                CAST(length(r.event_clean) AS BIGINT) AS event_length,
                CAST({any_token_sql('r.event_clean', C.SQL_TOKENS)} AS BIGINT) AS has_sql_tokens,
                CAST({any_token_sql('r.event_clean', C.PRIV_TOKENS)} AS BIGINT) AS has_priv_tokens,
                CAST({any_token_sql('r.event_clean', C.MALWARE_TOKENS)} AS BIGINT) AS has_malware_tokens
         FROM rated r JOIN ipstat i USING (src_ip))"""
