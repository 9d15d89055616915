"""Per-IP features: the bucketed ±30 s rate equals brute force, hot key included."""
import random

from pyspark.sql import functions as F

from logsight.operators.features import add_behavioural_features, ip_profile


def _brute_rate(rows):
    out = {}
    for rid, ip, sec in rows:
        if sec is None:
            out[rid] = 0
        else:
            out[rid] = sum(1 for _, ip2, s2 in rows if ip2 == ip and s2 is not None and abs(s2 - sec) <= 30)
    return out


def test_rate_matches_brute_force_across_bucket_edges(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        ip = "unknown" if i % 3 else f"10.0.0.{i % 5}"  # two thirds on one hot key
        sec = None if i % 17 == 0 else 1786320000 + 3600 * rnd.randint(0, 2) + rnd.choice(
            [rnd.randint(0, 60), rnd.randint(3540, 3599)])
        rows.append((i, ip, sec))
    df = spark.createDataFrame([(r, ip, s, None, "", "x") for r, ip, s in rows],
                               "row_id long, src_ip string, ts_sec long, dst_port double, username string, "
                               "event_clean string")
    got = {r["row_id"]: r["ip_rate_1min"] for r in add_behavioural_features(df).collect()}
    assert got == _brute_rate(rows)


def test_ip_profile(spark):
    df = spark.createDataFrame(
        [(1, "a", 22.0, "", "failed login"), (2, "a", 22.0, "bob", "ok"), (3, "a", None, "bob", "403 forbidden"),
         (4, "b", 80.0, "", "fine")],
        "row_id long, src_ip string, dst_port double, username string, event_clean string")
    p = {r["src_ip"]: r for r in ip_profile(df).collect()}
    assert p["a"]["ip_event_count"] == 3 and p["a"]["ip_unique_ports"] == 1
    assert p["a"]["ip_unique_users"] == 2  # '' counts as a user
    assert abs(p["a"]["ip_fail_ratio"] - 2 / 3) < 1e-9
    assert p["b"]["ip_fail_ratio"] == 0.0


def test_hot_key_window_partitions_stay_bounded(spark):
    """Every event on one IP (the 'unknown' case): the RANGE window still
    sees at most one hour of distinct seconds plus the ghost margins."""
    from logsight.operators.features import RATE_BUCKET_SECONDS, ip_second_counts, place_in_buckets
    from logsight.plans.queries_stats import scored
    hot = scored(spark, "/root/testdata/sf0.01").withColumn("src_ip", F.lit("unknown")).withColumn(
        "ts_sec", F.col("event_sec"))
    placed = place_in_buckets(ip_second_counts(hot))
    biggest = placed.groupBy("src_ip", "_b").count().agg(F.max("count")).first()[0]
    assert biggest <= RATE_BUCKET_SECONDS + 2 * 30
    total_events = placed.filter("_home").agg(F.sum("n")).first()[0]
    assert total_events == hot.count()
