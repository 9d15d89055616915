"""Plan shape on the hot path: no Python in parsing, skew-safe windows."""
from logsight.plans.inputs import clean_lines, parsed_lines

SMOKE = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parse_has_no_python(spark):
    plan = _plan(parsed_lines(spark, SMOKE))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_rate_window_is_bucketed(spark):
    plan = _plan(clean_lines(spark, SMOKE))
    windows = [ln for ln in plan.splitlines() if "Window [" in ln or "Window" in ln and "specifiedwindowframe" in ln]
    assert windows, plan
    for ln in windows:
        assert "_b" in ln, ln  # partitioned by (src_ip, hour bucket), never by src_ip alone


def test_parquet_scan_is_pruned(spark):
    plan = _plan(parsed_lines(spark, SMOKE))
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    assert "value" not in scan.split("ReadSchema")[1]
    assert "props" not in scan.split("ReadSchema")[1]


def test_filter_on_parsed_fields_stays_small(spark):
    # a pushed-down filter carries one parse expression, not a copy per reference
    df = parsed_lines(spark, SMOKE)
    n = df.filter("parse_ok AND src_ip IS NOT NULL AND username IS NOT NULL").count()
    assert 0 < n <= df.count()
    plan = df.filter("parse_ok")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 200_000
