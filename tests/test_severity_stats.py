"""Severity rule, confidence floor and statistic invariants."""
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.operators import severity as SV
from logsight.operators import stats as ST
from logsight.plans.queries_stats import scored

SMOKE = "/root/testdata/sf0.001"


def test_rule_cases(spark):
    rows = [(1, "1.1.1.1", "Port Scan", 0.95), (2, "1.1.1.1", "Port Scan", 0.60), (3, "2.2.2.2", "Malware Activity", 0.70),
            (4, "2.2.2.2", "Normal", 0.99), (5, "3.3.3.3", "SQL Injection", 0.50), (6, "3.3.3.3", "Weird", 0.70)]
    df = spark.createDataFrame(rows, "row_id long, src_ip string, predicted_category string, confidence double")
    out = {r["row_id"]: r for r in SV.assign_severity(SV.apply_confidence_floor(df)).collect()}
    assert out[1]["severity"] == "Medium"     # Low + up
    assert out[2]["severity"] == "Low"        # Low - down, clamped
    assert out[3]["severity"] == "Critical"   # base Critical
    assert out[4]["severity"] is None         # Normal
    assert out[5]["predicted_category"] == "Normal" and out[5]["low_confidence"] and not out[5]["is_anomaly"]
    assert out[6]["severity"] == "Low"        # unknown category -> base Low


def test_repeat_attacker_bumps(spark):
    rows = [(i, "9.9.9.9", "Brute Force", 0.70) for i in range(25)]
    df = spark.createDataFrame(rows, "row_id long, src_ip string, predicted_category string, confidence double")
    sev = {r["severity"] for r in SV.assign_severity(df).collect()}
    assert sev == {"High"}


def test_invariants(spark):
    sc = scored(spark, SMOKE)
    t = ST.totals(sc).first()
    assert t["total_attacks"] + t["total_normal"] == t["total_records"]
    cats = ST.category_breakdown(sc).collect()
    assert sum(r["count"] for r in cats) == t["total_attacks"]
    sev = ST.severity_breakdown(sc).collect()
    assert [r["severity"] for r in sorted(sev, key=lambda r: r["severity_rank"])] == C.SEVERITY_LEVELS
    assert sum(r["count"] for r in sev) == t["total_attacks"]
    conf = sc.agg(F.min("confidence"), F.max("confidence")).first()
    assert 0.0 <= conf[0] <= conf[1] <= 1.0
    assert len(ST.top_detections(sc).collect()) <= C.TOP_DETECTIONS


def test_no_attacks_gives_empty_timeline(spark):
    df = spark.createDataFrame([(i, 1786320000 + i, "Normal") for i in range(10)],
                               "row_id long, ts_sec long, predicted_category string")
    assert ST.attack_timeline(df).count() == 0
