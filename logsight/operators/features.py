"""Behavioural features per source IP (AGG13, WIN1, JN1) and per event (STR3/4).

Plan shape, chosen for skew (every IP-less row shares ``"unknown"``):

* per-IP statistics: one ``groupBy(src_ip)`` — partial aggregation map-side,
  so a hot IP is a handful of rows per map task before the shuffle;
* ±30 s rate: pre-aggregate to (src_ip, ts_sec, n), then a RANGE window
  partitioned by (src_ip, hour bucket) with rows near a bucket edge copied
  into the neighbouring bucket ("ghosts", dropped after). No window
  partition holds more than ~3,660 distinct seconds of one IP, however hot;
* both lookups are joined into one (src_ip, ts_sec) table and attached to the
  events with a single null-safe equi-join (AQE may broadcast it when the
  runtime size is small, and splits skewed partitions otherwise).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.functions.text import has_any_token

RATE_BUCKET_SECONDS = 3600
FEATURE_COLUMNS = ["ip_event_count", "ip_rate_1min", "ip_unique_ports", "ip_fail_ratio",
                   "ip_unique_users", "event_length", "has_sql_tokens", "has_priv_tokens",
                   "has_malware_tokens"]


def failure_flag(text_col: str = "event_clean"):
    return has_any_token(F.coalesce(F.col(text_col), F.lit("")), C.FAIL_WORDS)


def ip_profile(df: DataFrame, text_col: str = "event_clean") -> DataFrame:
    """Per src_ip: event count, distinct ports (non-null), distinct users
    (non-null; '' counts as a user), failure ratio (AGG13)."""
    return (df.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("ip_event_count"),
        F.count_distinct("dst_port").alias("ip_unique_ports"),
        F.count_distinct("username").alias("ip_unique_users"),
        F.avg(failure_flag(text_col).cast("double")).alias("ip_fail_ratio")))


def ip_second_counts(df: DataFrame) -> DataFrame:
    """(src_ip, ts_sec, n): events per IP and second, null ts_sec kept."""
    return df.groupBy("src_ip", "ts_sec").agg(F.count(F.lit(1)).alias("n"))


def place_in_buckets(counts: DataFrame, window: int = C.RATE_WINDOW_SECONDS,
                     bucket: int = RATE_BUCKET_SECONDS) -> DataFrame:
    """(src_ip, ts_sec, n, _b, _home): each row in its hour bucket, plus a ghost
    copy in the neighbouring bucket when within ``window`` of the edge."""
    b = F.floor(F.col("ts_sec") / bucket)
    targets = F.array_compact(F.array(
        F.struct(b.alias("_b"), F.lit(True).alias("_home")),
        F.when(F.col("ts_sec") >= (b + 1) * bucket - window,
               F.struct((b + 1).alias("_b"), F.lit(False).alias("_home"))),
        F.when(F.col("ts_sec") < b * bucket + window,
               F.struct((b - 1).alias("_b"), F.lit(False).alias("_home")))))
    return counts.select("src_ip", "ts_sec", "n", F.explode(targets).alias("_t")).select(
        "src_ip", "ts_sec", "n", "_t._b", "_t._home")


def ip_rate(counts: DataFrame, window: int = C.RATE_WINDOW_SECONDS,
            bucket: int = RATE_BUCKET_SECONDS) -> DataFrame:
    """(src_ip, ts_sec, ip_rate_1min) for every (src_ip, ts_sec) of ``counts``:
    events of the same IP with |Δt| <= ``window`` s (both ends inclusive, self
    included); 0 where ts_sec is null (WIN1).

    Each row goes to its own hour bucket and, when it lies within ``window``
    of a bucket edge, also to the neighbouring bucket as a ghost (one
    ``explode``, no union: the counts are computed once). The window sums
    counts inside (src_ip, bucket); ghosts are dropped afterwards."""
    placed = place_in_buckets(counts, window, bucket)
    w = Window.partitionBy("src_ip", "_b").orderBy("ts_sec").rangeBetween(-window, window)
    return (placed.withColumn("ip_rate_1min", F.sum("n").over(w))
            .filter(F.col("_home"))
            .select("src_ip", "ts_sec",
                    F.when(F.col("ts_sec").isNull(), F.lit(0)).otherwise(F.col("ip_rate_1min"))
                     .cast("bigint").alias("ip_rate_1min")))


def ip_lookup(df: DataFrame, text_col: str = "event_clean") -> DataFrame:
    """One row per (src_ip, ts_sec) with every per-IP feature."""
    rate = ip_rate(ip_second_counts(df))
    return rate.join(ip_profile(df, text_col), "src_ip", "left")


def event_features(df: DataFrame, text_col: str = "event_clean") -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    return (df.withColumn("event_length", F.length(t).cast("bigint"))
              .withColumn("has_sql_tokens", has_any_token(t, C.SQL_TOKENS).cast("bigint"))
              .withColumn("has_priv_tokens", has_any_token(t, C.PRIV_TOKENS).cast("bigint"))
              .withColumn("has_malware_tokens", has_any_token(t, C.MALWARE_TOKENS).cast("bigint")))


def add_behavioural_features(df: DataFrame, text_col: str = "event_clean") -> DataFrame:
    """Attach every behavioural feature to each row (JN1). Expects src_ip
    already filled ('unknown') and ts_sec present."""
    lookup = ip_lookup(df, text_col).withColumnRenamed("src_ip", "_ip").withColumnRenamed("ts_sec", "_sec")
    cond = (F.col("src_ip") == F.col("_ip")) & F.col("ts_sec").eqNullSafe(F.col("_sec"))
    out = df.join(lookup, cond, "left").drop("_ip", "_sec")
    return event_features(out, text_col)
