"""Confidence floor, severity rule and category lookups (PRJ9, SEV1, SEV2L, JN2-JN5).

Lookups against the fixed category/level tables are literal ``map`` /
``array`` expressions (no join). The repeat-attacker term needs a per-IP
count: a ``groupBy(src_ip)`` with partial aggregation joined back, never a
window partitioned by IP (one hot IP would become one task).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsight import constants as C


def _levels() -> Column:
    return F.array(*[F.lit(x) for x in C.SEVERITY_LEVELS])


def severity_rank(col: Column | str) -> Column:
    """Low=0 .. Critical=3; null/unknown -> -1 (JN5)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.array_position(_levels(), c).cast("int") - 1, F.lit(-1))


def severity_name(rank: Column) -> Column:
    return F.element_at(_levels(), rank + 1)


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def base_severity(category: Column | str) -> Column:
    """Base level per attack category, default Low (JN2)."""
    c = F.col(category) if isinstance(category, str) else category
    return F.coalesce(literal_map(C.BASE_SEVERITY)[c], F.lit("Low"))


def apply_confidence_floor(df: DataFrame, category: str = "predicted_category",
                           confidence: str = "confidence",
                           threshold: float = C.CONFIDENCE_ANOMALY_THRESHOLD) -> DataFrame:
    """Round confidence to 4 dp; an attack call below ``threshold`` becomes
    Normal with low_confidence = true; is_anomaly = attack and not low (PRJ9)."""
    conf = F.round(F.col(confidence), 4)
    attack = F.col(category) != C.NORMAL_LABEL
    low = attack & (conf < threshold)
    return (df.withColumn(confidence, conf)
              .withColumn("low_confidence", low)
              .withColumn("is_anomaly", attack & ~low)
              .withColumn(category, F.when(low, F.lit(C.NORMAL_LABEL)).otherwise(F.col(category))))


def ip_attack_counts(df: DataFrame, category: str = "predicted_category") -> DataFrame:
    return (df.filter(F.col(category) != C.NORMAL_LABEL)
              .groupBy("src_ip").agg(F.count(F.lit(1)).alias("ip_attack_rows")))


def assign_severity(df: DataFrame, category: str = "predicted_category",
                    confidence: str = "confidence") -> DataFrame:
    """Base level, +1 if confidence >= 0.90 or the IP has >= 20 attack rows,
    -1 if confidence < 0.65 and not raised, clamped to Low..Critical; Normal
    rows get null (SEV1)."""
    counts = ip_attack_counts(df, category).withColumnRenamed("src_ip", "_sev_ip")
    joined = df.join(counts, df["src_ip"].eqNullSafe(counts["_sev_ip"]), "left").drop("_sev_ip")
    attack = F.col(category) != C.NORMAL_LABEL
    repeat = attack & (F.coalesce(F.col("ip_attack_rows"), F.lit(0)) >= C.SEVERITY_REPEAT_IP_THRESHOLD)
    up = (F.col(confidence) >= C.HIGH_CONFIDENCE_NOTE) | repeat
    down = (F.col(confidence) < C.LOW_CONFIDENCE_NOTE) & ~up
    level = severity_rank(base_severity(category)) + up.cast("int") - down.cast("int")
    level = F.greatest(F.lit(0), F.least(F.lit(len(C.SEVERITY_LEVELS) - 1), level))
    return (joined.withColumn("severity", F.when(attack, severity_name(level)))
                  .drop("ip_attack_rows"))


def legacy_severity(category: Column | str) -> Column:
    """Static category -> level table, unknown -> Medium (SEV2L)."""
    c = F.col(category) if isinstance(category, str) else category
    return F.coalesce(literal_map(C.LEGACY_SEVERITY)[c], F.lit(C.LEGACY_SEVERITY_DEFAULT))


def known_categories(df: DataFrame, category: str = "category") -> DataFrame:
    """Keep rows whose category has a base severity (FLT5)."""
    return df.filter(F.col(category).isin(*C.BASE_SEVERITY))
