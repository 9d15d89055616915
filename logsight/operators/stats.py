"""Dashboard / report statistics over a scored table (AGG1-AGG7, WIN2, SRT2-SRT6).

Expected columns: row_id, ts_sec (nullable), src_ip, username, dst_port,
predicted_category, severity, confidence, low_confidence, event.
Every figure is a distributed aggregate; only its tiny result (≤ 25 rows) is
ever ordered globally. Ties break on the natural key ascending.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.functions.timestamps import format_seconds
from logsight.operators.severity import severity_name, severity_rank

TIMELINE_UNITS = (("minute", 60), ("hour", 3600), ("day", 86400))
MAX_BUCKETS = 60


def pct_1dp(part: Column, whole: Column) -> Column:
    """round(part * 100 / whole, 1), half-up on the exact ratio; 0 if whole is 0."""
    return F.when(whole > 0, ((part * 2000 + whole) / (whole * 2)).cast("long") / 10.0).otherwise(F.lit(0.0))


def excerpt(col: str, chars: int | None) -> Column:
    """STR9: the first ``chars`` characters, or all."""
    return F.col(col) if chars is None else F.substring(col, 1, chars)


def is_attack(category: str = "predicted_category") -> Column:
    return F.col(category) != C.NORMAL_LABEL


def attacks(df: DataFrame) -> DataFrame:
    """FLT2."""
    return df.filter(is_attack())


def totals(df: DataFrame) -> DataFrame:
    """AGG1: total, attacks, normal, attack_pct (1 dp), low_confidence_count."""
    return (df.agg(F.count(F.lit(1)).alias("total_records"),
                   F.count_if(is_attack()).alias("total_attacks"),
                   F.count_if(F.col("low_confidence")).alias("low_confidence_count"))
              .withColumn("total_normal", F.col("total_records") - F.col("total_attacks"))
              .withColumn("attack_pct", pct_1dp(F.col("total_attacks"), F.col("total_records"))))


def category_breakdown(df: DataFrame) -> DataFrame:
    """AGG2: attacks per category with share of all attacks (1 dp)."""
    counts = attacks(df).groupBy("predicted_category").agg(F.count(F.lit(1)).alias("count"))
    # the window spans at most one row per category
    whole = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("share", pct_1dp(F.col("count"), whole))


def severity_breakdown(df: DataFrame) -> DataFrame:
    """AGG3: attack count per level, all four levels present."""
    levels = df.sparkSession.createDataFrame(
        [(i, name) for i, name in enumerate(C.SEVERITY_LEVELS)], "severity_rank int, severity string")
    counts = attacks(df).groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
    return (levels.join(F.broadcast(counts), "severity", "left")
                  .select("severity", "severity_rank", F.coalesce("count", F.lit(0)).alias("count")))


def top_attacker_ips(df: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """AGG4: per IP attacks, dominant category (mode; ties -> alphabetically
    first), max severity; top k by (attacks, max severity) desc."""
    per_ip = (attacks(df).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("attacks"),
        F.mode("predicted_category", deterministic=True).alias("dominant"),
        F.max(severity_rank("severity")).alias("_max_rank")))
    return (per_ip.orderBy(F.desc("attacks"), F.desc("_max_rank"), F.asc("src_ip")).limit(k)
                  .select("src_ip", "attacks", "dominant", severity_name(F.col("_max_rank")).alias("max_severity")))


def top_targeted_users(df: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """AGG5: attacks per non-empty username, top k."""
    return (attacks(df).filter(F.col("username") != "").groupBy("username")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("username")).limit(k))


def top_targeted_ports(df: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """AGG6 + FLT3: attacks per service port (< 49152), top k."""
    return (attacks(df).filter(F.col("dst_port").isNotNull() & (F.col("dst_port") < C.SERVICE_PORT_LIMIT))
            .groupBy(F.col("dst_port").cast("int").alias("port"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("port")).limit(k))


def attack_timeline(df: DataFrame, ts: str = "ts_sec", unit: str | None = None) -> DataFrame:
    """WIN2: attacks per tumbling bucket; the unit, if not given, is the first of
    minute / hour / day with <= 60 buckets over the span of *all* timestamps. Sparse.
    No rows when there are no attacks, < 5 timestamps, a zero span, or no
    timestamped attacks.

    The span statistics are one global aggregate (exactly one row), attached
    to the attack rows with a broadcast equi-join on a constant key: no
    driver round trip, no single-partition window."""
    span = (df.agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count(ts).alias("_n"))
              .withColumn("_span", F.col("_hi") - F.col("_lo"))
              .filter((F.col("_n") >= 5) & (F.col("_span") > 0))
              .withColumn("_k", F.lit(1)))
    fixed = unit or TIMELINE_UNITS[-1][0]
    seconds, name = F.lit(dict(TIMELINE_UNITS)[fixed]), F.lit(fixed)
    for label, secs in reversed(TIMELINE_UNITS[:-1] if unit is None else ()):
        fits = F.col("_span") / secs <= MAX_BUCKETS
        seconds = F.when(fits, F.lit(secs)).otherwise(seconds)
        name = F.when(fits, F.lit(label)).otherwise(name)
    span = span.select("_k", seconds.alias("_unit"), name.alias("unit"))
    timed = attacks(df).filter(F.col(ts).isNotNull()).select(ts).withColumn("_k", F.lit(1))
    bucket = F.col(ts) - F.pmod(F.col(ts), F.col("_unit"))
    label = F.when(F.col("unit") == "day", format_seconds("_bucket", "yyyy-MM-dd")).otherwise(
        format_seconds("_bucket", "yyyy-MM-dd HH:mm"))
    return (timed.join(F.broadcast(span), "_k")
            .groupBy(bucket.alias("_bucket"), "unit").agg(F.count(F.lit(1)).alias("count"))
            .select(label.alias("time"), "unit", "count"))


TIMELINE_REASONS = (
    ("no_attacks", "There is no attack to place on a timeline."),
    ("few_timestamps", "Fewer than five records carry a readable time."),
    ("one_instant", "Every record carries the same time."),
    ("attacks_without_time", "No attack record carries a readable time."),
)


def timeline_reason(df: DataFrame, ts: str = "ts_sec") -> DataFrame:
    """AGG7: one row (code, reason) that says why :func:`attack_timeline` is
    empty; both null when it is not."""
    row = df.agg(F.count_if(is_attack()).alias("a"), F.count(ts).alias("n"), (F.max(ts) - F.min(ts)).alias("span"),
                 F.count_if(is_attack() & F.col(ts).isNotNull()).alias("ta"))
    tests = (F.col("a") == 0, F.col("n") < 5, F.col("span") <= 0, F.col("ta") == 0)
    code, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, (name, words) in reversed(list(zip(tests, TIMELINE_REASONS))):
        code, text = F.when(test, name).otherwise(code), F.when(test, words).otherwise(text)
    return row.select(code.alias("code"), text.alias("reason"))


def top_detections(df: DataFrame, k: int = C.TOP_DETECTIONS, event_chars: int | None = None) -> DataFrame:
    """SRT2: the k most severe attack rows by (severity rank, confidence)
    desc, row_id asc; a bounded TakeOrderedAndProject."""
    return (attacks(df)
            .orderBy(F.desc(severity_rank("severity")), F.desc("confidence"), F.asc("row_id")).limit(k)
            .select("row_id", format_seconds("ts_sec").alias("timestamp"), "src_ip", "username",
                    "predicted_category", "severity", "confidence",
                    excerpt("event", event_chars).alias("event")))


def worst_finding(df: DataFrame) -> DataFrame:
    """SRT6: the first of the top detections and the most frequent category."""
    top = top_detections(df, 1)
    cat = (category_breakdown(df).orderBy(F.desc("count"), F.asc("predicted_category")).limit(1)
           .select(F.col("predicted_category").alias("top_category"), F.col("count").alias("top_category_count")))
    # both sides hold at most one row
    return (top.withColumn("_k", F.lit(1)).join(cat.withColumn("_k", F.lit(1)), "_k", "left")
               .drop("_k"))
