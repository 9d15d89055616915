"""Search by the gram index against the plain filter, and what it reads."""
import random

from pyspark.sql import functions as F

from logsight.operators import search as S
from logsight.operators.detections import filter_detections

SCHEMA = "row_id long, event string, src_ip string, username string, predicted_category string, severity string, is_anomaly boolean"


def _rows(n, seed=3):
    rnd = random.Random(seed)
    words = ["Failed", "password", "für", "ROOT", "%41", "a_b", "İx", "😀ok", "", "  "]
    out = []
    for i in range(n):
        event = rnd.choice([None, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 5)))])
        # a third of the rows share one address; ids repeat and may be null
        out.append((rnd.choice([None, i, i // 2]), event, "10.0.0.1" if i % 3 == 0 else rnd.choice([None, f"10.9.{i % 7}.{i}"]),
                    rnd.choice([None, "user1", "User22"]), rnd.choice(["DoS", "Port Scan"]), rnd.choice(["High", "Low"]), i % 5 != 0))
    return out


def _as_bag(df):
    return sorted(map(repr, df.collect()))


def test_index_finds_what_the_filter_finds(spark, monkeypatch):
    df = spark.createDataFrame(_rows(400) + [(900, "needle " + "x" * 50_000 + " hay", "1.1.1.1", "", "DoS", "High", True)], SCHEMA)
    index = S.build_index(df)
    needles = ["failed pass", "FÜR", "10.9.3.", "user1", "😀ok", "a", "", None, "%41 a_b", "absent text", "x hay", "zzz", " root ", "0.0.1 user"]
    for share in (0.1, 0.9, 0.0):
        monkeypatch.setattr(S, "SHARE", share)
        for q in needles:
            assert _as_bag(index.search(q)) == _as_bag(filter_detections(df, query=q)), (share, q)
    assert _as_bag(index.search("user1", "DoS", "High")) == _as_bag(filter_detections(df, "DoS", "High", "user1"))
    assert index.search("failed").count() > 0


def test_only_the_needles_buckets_are_read(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.concat(F.lit("event "), F.sha1(F.col("id").cast("string"))).alias("event"),
                                  F.lit("ip").alias("src_ip"), F.lit("u").alias("username"), F.lit("DoS").alias("predicted_category"),
                                  F.lit("High").alias("severity"), F.lit(True).alias("is_anomaly"))
    index = S.build_index(df)
    needle = df.filter("row_id = 77").first()["event"][10:22]
    part = index._of(index.postings, [needle[:3], needle[3:6]])
    assert len(part.select("bucket").distinct().collect()) <= 2 < S.BUCKETS / 2
    plan = part._jdf.queryExecution().executedPlan().toString()
    # buckets are constants in the partition filters, grams reach the files
    assert "PartitionFilters: [bucket" in plan and "xxhash64" not in plan and "PushedFilters: [In(gram" in plan
    assert [r["row_id"] for r in index.search(needle).collect()] == [77]


def test_empty_table(spark):
    index = S.build_index(spark.createDataFrame([], SCHEMA))
    assert index.search("failed").count() == 0 and index.search("").count() == 0
