"""Single-line parsing examples (apache > syslog > iso > generic)."""
from logsight.functions.lineparse import parse_lines


def _parse(spark, *lines):
    df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(lines)], "row_id long, value string")
    return {r["row_id"]: r.asDict() for r in parse_lines(df).collect()}


def test_syslog_lines(spark):
    r = _parse(spark, "Feb  3 04:05:06 edge-7 cron[88]: session opened for user backup by uid=0, peer 172.16.9.200 port 60022",
               "Feb  3 04:05:06 edge-7 sudo: nothing to see",
               "Feb  3 04:05:06 edge-7 sshd[9]: error: Invalid user",
               "Feb  3 04:05:06 edge-7 sshd[9]: login user=eve; invalid user mallory from 10.1.1.1")
    assert [r[1][c] for c in ("format", "host", "prog", "ts_raw")] == ["syslog", "edge-7", "cron", "Feb  3 04:05:06"]
    assert [r[1][c] for c in ("src_ip", "dst_port", "username")] == ["172.16.9.200", 60022.0, "backup"]
    assert r[1]["event"].startswith("cron: session opened")
    assert r[2]["prog"] == "sudo" and r[2]["src_ip"] is None and r[2]["parse_ok"]
    # "invalid user" names the user or nobody, whatever was found before
    assert r[3]["username"] is None and r[4]["username"] == "mallory"


def test_access_lines(spark):
    r = _parse(spark, '203.0.113.77 - carol [01/Feb/2025:23:59:59 -0330] "POST /api/v2/items?q=a%20b HTTP/2" 503 -',
               '203.0.113.78 - - [01/Feb/2025:23:59:59 -0330] "CONNECT db.example.org:5432 HTTP/1.1" 200 17 "-" "probe/1"')
    assert [r[1][c] for c in ("format", "src_ip", "username", "status", "bytes")] == ["apache", "203.0.113.77", "carol", "503", None]
    assert r[1]["event"] == "POST /api/v2/items?q=a%20b" and r[1]["ts_raw"] == "01/Feb/2025:23:59:59 -0330"
    # a request for host:port names the port; "-" is no user
    assert r[2]["dst_port"] == 5432.0 and r[2]["username"] is None and r[2]["bytes"] == 17.0


def test_application_lines(spark):
    r = _parse(spark, "2025-02-01T23:59:59.250 ERROR pool exhausted account=svc.batch client=198.51.100.4 elapsed=1.75 status=504 len=77")[1]
    assert [r[c] for c in ("format", "ts_raw", "src_ip", "username")] == ["iso", "2025-02-01T23:59:59.250", "198.51.100.4", "svc.batch"]
    assert [r[c] for c in ("duration", "status", "bytes")] == [1.75, "504", 77.0]
    assert r["event"].startswith("pool exhausted")


def test_other_and_blank_lines(spark):
    out = _parse(spark, "\t", "kettle on, toast burning", "")
    assert list(out) == [2]
    assert out[2]["format"] == "generic" and out[2]["event"] == "kettle on, toast burning" and not out[2]["parse_ok"]


def test_generic_timestamp_removed_first_occurrence(spark):
    r = _parse(spark, "seen at 1755171751 from 10.1.2.3 src=10.9.9.9 user=bob")[1]
    assert r["ts_raw"] == "1755171751"
    assert r["event"] == "seen at  from 10.1.2.3 src=10.9.9.9 user=bob"
    # first IPv4 wins over src= on generic lines
    assert r["src_ip"] == "10.1.2.3"
    assert r["username"] == "bob"


def test_syslog_kv_first_and_invalid_user_override(spark):
    r = _parse(spark, "Aug 14 10:22:31 h sshd[1]: Failed password for invalid user guest from 10.0.0.9 port 4242 ssh2",
               "Aug 14 10:22:31 fw kernel: DROP SRC=1.2.3.4 DPT=22 src=5.6.7.8")
    assert r[1]["username"] == "guest" and r[1]["dst_port"] == 4242.0
    # kv keys are case-sensitive; lower-case src= wins over the first IPv4
    assert r[2]["src_ip"] == "5.6.7.8"


def test_spread_deals_rows_not_splits(spark):
    from pyspark.sql import functions as F
    from logsight.session import TASK_ROWS, spread
    # twice as many splits as cores, yet of 125,000 rows each
    many = spread(spark.range(0, 20 * TASK_ROWS, 1, 8))
    sizes = [r["n"] for r in many.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 20 * TASK_ROWS and max(sizes) <= 1.1 * TASK_ROWS


def test_parse_evaluates_the_line_once(spark):
    from pyspark.sql import functions as F
    from logsight.functions.lineparse import parse_lines
    df = spark.createDataFrame([(1, "  "), (2, None), (3, " user=bob src=10.0.0.1 note ")], "row_id long, value string")
    parsed = parse_lines(df.withColumn("value", F.reverse(F.reverse("value"))))
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("reverse(reverse(") == 1
    rows = parsed.collect()
    assert [(r["row_id"], r["username"], r["src_ip"]) for r in rows] == [(3, "bob", "10.0.0.1")]
