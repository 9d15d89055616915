"""Test inputs derived by Spark from the driver tables (FIXTURES.md part B).

* ``log_lines``: one raw log line per ``events`` row; every fourth line is
  syslog / apache / ISO / generic.
* ``scored_events``: a deterministic "already classified" event table, so
  severity, statistics and detections can be checked without a model.

Both are narrow projections of ``events`` with no shuffle; their size grows
with ``events``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsight.session import read_table, spread

SEC_EXPR = ("1786320000 + (timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', "
            "CAST(ts AS TIMESTAMP_NTZ)) div 300) - 5680000")
#: Added to the row id of a line that comes again.
REPEAT = 10_000_000_000
TS_EXPR = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, sec)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id BIGINT, value STRING, label STRING).

    Every eighth line has neither time nor address, some have a time that cannot
    be, key=value fields, a request for host:port or malware words, and every tenth
    line comes again at the end under a row id of its own (``REPEAT`` on)."""
    ev = spread(read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"))
    c = ev.selectExpr(
        "event_id AS row_id", "event_id", "event_type", "user_id", f"{SEC_EXPR} AS sec",
        "concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(10 + user_id % 12 AS STRING)) AS ip",
        "CAST(20 + (event_id * 37) % 60000 AS BIGINT) AS port",
        "concat('user', CAST(user_id % 20 AS STRING)) AS usr")
    m = c.selectExpr("*", """CASE event_type
        WHEN 'error'    THEN concat('Failed password for ', usr, ' from ', ip, ' port ', CAST(port AS STRING), ' ssh2')
        WHEN 'signup'   THEN concat('Invalid user ', usr, ' from ', ip, ' port ', CAST(port AS STRING))
        WHEN 'purchase' THEN concat('query id=1%27%20OR%201=1-- src=', ip, ' user=', usr)
        WHEN 'click'    THEN concat('sudo COMMAND=/bin/sh user=', usr, ' src=', ip, ' bytes=', CAST(port AS STRING))
        ELSE concat('Accepted password for ', usr, ' from ', ip, ' port 22 ssh2') END AS msg""",
                     f"{TS_EXPR} AS tsx")
    m = m.selectExpr("*", f"CASE WHEN event_id % 10 = 0 THEN array(event_id, event_id + {REPEAT}) ELSE array(event_id) END AS ids")
    return m.drop("row_id").selectExpr("explode(ids) AS row_id", """CASE
      WHEN event_id % 8 = 7 THEN concat('maintenance note by ', usr, ' on shelf ', CAST(user_id % 9 AS STRING))
      WHEN event_id % 40 = 6 THEN concat(date_format(tsx, 'yyyy-MM-dd HH:mm:ss'), ' ERROR powershell -enc ZQBj drops mimikatz src=', ip,
           ' dst=10.9.9.', CAST(user_id % 20 AS STRING), ' dport=443 duration=1.5 status=503 len=88 user=', usr)
      WHEN event_id % 40 = 9 THEN concat(ip, ' - - [', date_format(tsx, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] "CONNECT proxy:',
           CAST(8000 + user_id % 50 AS STRING), '/x HTTP/1.1" 502 -')
      WHEN event_id % 60 = 10 THEN concat('2026-13-45 10:00:00 WARN ', msg)
      ELSE CASE event_id % 4
      WHEN 0 THEN concat(date_format(tsx, 'MMM dd HH:mm:ss'), ' host', CAST(user_id % 5 AS STRING),
                         ' sshd[', CAST(100 + user_id AS STRING), ']: ', msg)
      WHEN 1 THEN concat(ip, ' - ', CASE WHEN event_type = 'click' THEN usr ELSE '-' END, ' [',
                         date_format(tsx, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] "GET /', event_type,
                         '?id=', CAST(user_id AS STRING), '%27 HTTP/1.1" ',
                         CASE WHEN event_type = 'error' THEN '403' ELSE '200' END, ' ', CAST(port AS STRING))
      WHEN 2 THEN concat(date_format(tsx, 'yyyy-MM-dd HH:mm:ss'), ' WARN ', msg)
      ELSE concat('seen at ', CAST(sec AS STRING), ' ', msg) END END AS value""",
                        """CASE WHEN event_id % 40 = 6 THEN 'Malware Activity' WHEN event_id % 40 = 9 THEN 'DoS Indicators'
        ELSE CASE event_type WHEN 'error' THEN 'Brute Force' WHEN 'signup' THEN 'Port Scan'
        WHEN 'purchase' THEN 'SQL Injection' WHEN 'click' THEN 'Privilege Escalation'
        ELSE 'Normal' END END AS label""")


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, ts_sec, src_ip, username, dst_port, raw_category, confidence, event, event_sec)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return ev.selectExpr(
        "event_id AS row_id", f"{SEC_EXPR} AS ts_sec",
        """CASE WHEN event_id % 50 = 0 THEN 'unknown'
             ELSE concat('10.1.', CAST(user_id % 250 AS STRING), '.', CAST(event_id % 2 AS STRING)) END AS src_ip""",
        "CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('user', CAST(user_id % 20 AS STRING)) END AS username",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(20 + (event_id * 37) % 60000 AS INT) END AS dst_port",
        """CASE event_type WHEN 'error' THEN 'Brute Force' WHEN 'signup' THEN 'Port Scan'
             WHEN 'purchase' THEN 'SQL Injection'
             WHEN 'click' THEN CASE event_id % 3 WHEN 0 THEN 'Privilege Escalation'
                                                 WHEN 1 THEN 'Malware Activity' ELSE 'DoS Indicators' END
             ELSE 'Normal' END AS raw_category""",
        "CAST(400 + (event_id * 7919) % 601 AS DOUBLE) / 1000 AS confidence",
        "concat(event_type, ' event ', CAST(event_id AS STRING), ' by user', CAST(user_id % 20 AS STRING)) AS event",
        "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) AS event_sec",
    )
