"""Sinks, model persistence and the end-to-end analysis."""
import os

from pyspark.sql import functions as F

from logsight.operators import model as M
from logsight.plans import queries_ml as QM
from logsight.plans.analyse import analyse
from logsight.plans.inputs import canonical_lines
from logsight.sources.sinks import to_spreadsheet_safe, write_results

SMOKE = "/root/testdata/sf0.001"


def test_write_results_partitioned(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 1786320000, "=cmd"), (2, None, "ok")], "row_id long, ts_sec long, event string")
    paths = write_results({"scored": df, "totals": df.groupBy().count()}, tmpdir_path, "run1")
    back = spark.read.parquet(paths["scored"])
    assert {r["event_date"] for r in back.collect()} == {"2026-08-10", "none"}
    assert back.filter(F.col("run_id") == "run1").count() == 2
    safe = to_spreadsheet_safe(df).orderBy("row_id").first()["event"]
    assert safe == "'=cmd"


def test_model_roundtrip_and_analysis(spark, tmpdir_path):
    model, test, data = QM.trained(spark, SMOKE)
    path = M.save_model(model, os.path.join(tmpdir_path, "model"))
    again = M.load_model(path)
    a = M.score(model, test).select("row_id", "predicted_category").orderBy("row_id").collect()
    b = M.score(again, test).select("row_id", "predicted_category").orderBy("row_id").collect()
    assert a == b
    result = analyse(canonical_lines(spark, SMOKE), model, assume_year=2026)
    t = result.figures["totals"].first()
    assert t["total_records"] == result.scored.count() > 0
    assert t["total_attacks"] + t["total_normal"] == t["total_records"]
    card = M.model_card(model, data, test).first()
    assert 0.0 <= card["accuracy"] <= 1.0 and len(card["per_class"]) >= 2
