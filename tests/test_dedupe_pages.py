"""Duplicates across deliveries, and pages of detections read from either end."""
import random

import pytest
from pyspark.sql import functions as F

from logsight.operators import detections as D
from logsight.streaming import streams as ST

SCHEMA = "ts_raw string, src_ip string, event string, n long"


def _deliver(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def _stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_every_key_is_kept_once_over_deliveries_and_runs(spark, tmpdir_path):
    src, store = tmpdir_path + "/in", tmpdir_path + "/store"
    _deliver(spark, src, "a", [("t1", "ip", "e", 1), ("t1", "ip", "e", 1), (None, "ip", "e", 2), (None, None, None, 3), ("", "ip", "e", 4)])
    _deliver(spark, src, "b", [(None, "ip", "e", 9), ("t1", "ip", "e", 9), ("t2", "ip", "e", 5), (None, None, None, 9)])
    first = ST.run_deduped(_stream(spark, src), store=store)
    assert sorted(tuple("~" if r[c] is None else r[c] for c in ("ts_raw", "src_ip")) for r in first.collect()) == [
        ("", "ip"), ("t1", "ip"), ("t2", "ip"), ("~", "ip"), ("~", "~")]
    # a later run goes on: old keys stay out, a key long past every watermark too
    _deliver(spark, src, "c", [("t1", "ip", "e", 10), ("t0", "ip", "e", 6), ("t0", "ip", "e", 6)])
    again = ST.run_deduped(_stream(spark, src), store=store)
    assert again.count() == 6 and again.filter("ts_raw = 't0'").count() == 1


def test_a_delivery_tried_again_changes_nothing(spark, tmpdir_path):
    keys = ("ts_raw", "src_ip", "event")
    a = spark.createDataFrame([("t1", "ip", "e", 1), (None, "ip", "e", 2)], SCHEMA)
    b = spark.createDataFrame([("t1", "ip", "e", 1), ("t2", "ip", "e", 3)], SCHEMA)
    for number, batch in ((0, a), (0, a), (1, b), (1, b), (2, b.limit(0))):
        ST.merge_delivery(batch, number, tmpdir_path, keys)
    rows = spark.read.parquet(tmpdir_path + "/rows")
    assert sorted((r["n"], r["delivery"]) for r in rows.collect()) == [(1, 0), (2, 0), (3, 1)]
    assert spark.read.parquet(tmpdir_path + "/keys").count() == 3


@pytest.mark.parametrize("key,ascending", [("severity", False), ("time", True), ("src_ip", False), ("none", False)])
def test_pages_from_either_end_and_between(spark, monkeypatch, key, ascending):
    monkeypatch.setattr(D, "END_ROWS", 20)
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, 1, 2, 3]), rnd.choice([None, "a", "b"]), "u", "DoS", rnd.choice(["Low", "High", "Critical"]),
             rnd.choice([0.5, 0.7]), "e") for i in range(95)]
    df = spark.createDataFrame(rows, "row_id long, ts_sec long, src_ip string, username string, predicted_category string, "
                                     "severity string, confidence double, event string")
    order = [r["row_id"] for r in df.orderBy(*D.sort_keys(key, ascending)).collect()]
    for no in (1, 2, 5, 9, 10, 99):
        p = min(no, 10)
        got = sorted((r["pos"], r["row_id"], r["page"]) for r in D.page(df, key, ascending, no, per_page=10).collect())
        assert got == [(k + 1, order[k], p) for k in range((p - 1) * 10, min(p * 10, 95))]
    assert D.page(df.limit(0), key, ascending, 3).count() == 0
