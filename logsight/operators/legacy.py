"""The older pipeline generation, kept where it is a different data operator
(ids ending in L): keyword line parser, 8 numeric features, static severity,
generic missing-value fill, subset dedupe, summary statistics."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsight import constants as C
from logsight.functions.text import count_tokens, nonblank, strip_ws
from logsight.functions.timestamps import calendar_features, legacy_normalise_timestamp


def _by_first_letter(pattern: str) -> str:
    """The alternation of plain words ``pattern`` (any case), its words
    grouped by their first letter, so that a place in the text is tried once a letter. No word may begin
    another: then at most one of them matches at a place, in whatever order they stand."""
    words = re.fullmatch(r"\(\?i\)\(\?:([a-z|]+)\)", pattern).group(1).split("|")
    if any(a != b and b.startswith(a) for a in words for b in words):
        return pattern
    groups = {}
    for w in words:
        groups.setdefault(w[0], []).append(w[1:])
    return "(?i)(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items()) + ")"


_EVENT_RE = _by_first_letter(C.LEGACY_EVENT_RE)


def parse_lines_keywords(df: DataFrame, col: str = "value", line_col: str = "row_id",
                         event_chars: int | None = None) -> DataFrame:
    """LP13L: per non-blank line: first timestamp (4 alternatives), every IPv4
    joined ', ', the first IPv4, a username (2 alternatives), the distinct
    event keywords (sorted, joined ', '), the line (its first ``event_chars``, if given)."""
    s = F.col("_line")
    # each pattern runs once a line: matches are never empty, so an empty list joins to an empty text
    ips = F.nullif(F.array_join(F.regexp_extract_all(s, F.lit(C.IPV4_RE), 0), ", "), F.lit(""))
    kws = F.sort_array(F.array_distinct(F.regexp_extract_all(s, F.lit(_EVENT_RE), 0)))
    u1 = F.nullif(F.regexp_extract(s, C.LEGACY_USER_RE, 1), F.lit(""))
    u2 = F.nullif(F.regexp_extract(s, C.LEGACY_USER_RE, 2), F.lit(""))
    return (nonblank(df, col, "_line")
              .select(F.col(line_col).alias("line_number"), F.col("_line").alias("raw_line"),
                      F.nullif(F.regexp_extract(s, C.LEGACY_TS_RE, 1), F.lit("")).alias("timestamp"),
                      ips.alias("ip_addresses"),
                      F.regexp_substr(s, F.lit(C.IPV4_RE)).alias("source_ip"),
                      F.coalesce(u1, u2).alias("username"),
                      F.nullif(F.array_join(kws, ", "), F.lit("")).alias("event_keywords"),
                      (s if event_chars is None else F.substring(s, 1, event_chars)).alias("event_description")))


def _octet(ip: Column, i: int) -> Column:
    parts = F.split(F.coalesce(ip.cast("string"), F.lit("None")), r"\.")
    return F.coalesce(F.get(parts, i).try_cast("int"), F.lit(0))


def extract_features(df: DataFrame) -> DataFrame:
    """PIPE4L: hour, day_of_week, is_weekend, ip_first_octet,
    ip_second_octet, attack_keyword_count, has_attack_keywords, line_length."""
    # made once a row: each has several readers
    df = df.select("line_number", "event_keywords", "source_ip", "raw_line", legacy_normalise_timestamp("timestamp").alias("_sec"),
                   F.lower(F.col("event_keywords")).alias("_kw"))
    n_kw = F.when(F.col("event_keywords").isNull(), F.lit(0)).otherwise(count_tokens("_kw", C.LEGACY_ATTACK_KEYWORDS))
    df = df.withColumn("attack_keyword_count", n_kw)
    cal = calendar_features("_sec")
    return df.select(
        "line_number", cal["hour"].alias("hour"), cal["day_of_week"].alias("day_of_week"),
        cal["is_weekend"].alias("is_weekend"),
        _octet(F.col("source_ip"), 0).alias("ip_first_octet"), _octet(F.col("source_ip"), 1).alias("ip_second_octet"),
        "attack_keyword_count", (F.col("attack_keyword_count") > 0).cast("int").alias("has_attack_keywords"),
        F.coalesce(F.length("raw_line"), F.lit(0)).alias("line_length"))


def remove_duplicates(df: DataFrame, subset: list[str] | None = None, order_col: str = "line_number") -> DataFrame:
    """DD3L: drop rows equal to an earlier one on ``subset`` (all columns but
    ``order_col`` when None), keeping the first — one grouped ``min_by``. Where
    every column is compared (and is text or a whole number, so that equal values are
    the same), any of the equal rows is the first: the columns are grouped alone, hashed
    and not sorted, without a second copy of the row beside the key."""
    key = subset or [c for c in df.columns if c != order_col]
    cols = df.columns
    if set(key) == set(cols) and all(isinstance(f.dataType, (T.StringType, T.IntegralType)) for f in df.schema.fields):
        return df.dropDuplicates()
    return (df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)],
                      F.struct(*cols).alias("_row"), F.col(order_col).alias("_o"))
              .groupBy(*[f"_k{i}" for i in range(len(key))])
              .agg(F.min_by("_row", "_o").alias("_row")).select("_row.*"))


def exact_median(df: DataFrame, column: str) -> float | None:
    """Exact median (mean of the two middle values for an even count).

    Value counts are dealt to range partitions and staged; the running total of
    the partitions (one number each) names those that hold the middle ranks,
    and only they are searched, by a running sum inside the partition."""
    from logsight.session import stage
    x = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    counts = x.groupBy("x").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("x")
    counts = stage(counts.withColumn("p", F.spark_partition_id()), "value-counts")
    parts = {r["p"]: r["n"] for r in counts.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    total = sum(parts.values())
    if not total:
        return None
    found = []
    for rank in ((total - 1) // 2, total // 2):
        before = 0
        for p in sorted(parts):
            if rank < before + parts[p]:
                break
            before += parts[p]
        run = F.sum("n").over(Window.partitionBy("p").orderBy("x"))
        inside = counts.filter(F.col("p") == p).withColumn("_to", run)
        found.append(inside.filter(F.col("_to") > rank - before).agg(F.min("x")).first()[0])
    return sum(found) / 2.0


def fill_missing_generic(df: DataFrame, strategy: str = "fill", now: str | None = None,
                         approx: bool = False) -> DataFrame:
    """PRJ8: ``fill`` -> text 'unknown', numbers the column median (0 when all
    null), timestamps ``now``; ``drop`` -> drop rows with any null.

    One count finds the number columns with nulls; a column without keeps its
    values and type, and an integer column keeps its type when its median
    is whole. ``approx=True`` takes the medians from one quantile sketch."""
    if strategy == "drop":
        return df.na.drop("any")
    nums = [f for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.DoubleType,
                                                                    T.FloatType, T.ShortType))]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    if nums:
        # the count, the medians and the fill read the same rows
        from logsight.session import stage
        df = stage(df, "generic-fill")
        holes = df.agg(*[F.count_if(F.col(f.name).isNull()).alias(f.name) for f in nums]).first()
        nums = [f for f in nums if holes[f.name]]
    out = df
    if approx and nums:
        sketch = df.agg(*[F.percentile_approx(F.col(f.name).cast("double"), 0.5).alias(f.name) for f in nums]).first()
    for f in nums:
        m = (sketch[f.name] if approx else exact_median(df, f.name)) or 0.0
        whole = not isinstance(f.dataType, (T.DoubleType, T.FloatType)) and float(m).is_integer()
        value = F.lit(int(m)).cast(f.dataType) if whole else F.lit(float(m))
        column = F.col(f.name) if whole else F.col(f.name).cast("double")
        out = out.withColumn(f.name, F.coalesce(column, value))
    if texts:
        out = out.na.fill("unknown", subset=texts)
    if times and now is not None:
        for c in times:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(now).cast(df.schema[c].dataType)))
    return out


def attack_statistics(df: DataFrame, category: str = "category") -> DataFrame:
    """AGG17L: totals and attack percentage (2 dp, half-up)."""
    attack = F.col(category) != C.NORMAL_LABEL
    t = df.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(attack).alias("total_attacks"),
               F.count_if(~attack).alias("normal_records"))
    pct = F.when(F.col("total_records") > 0,
                 F.floor((F.col("total_attacks") * 20000 + F.col("total_records")) / (F.col("total_records") * 2))
                 / 100.0).otherwise(F.lit(0.0))
    return t.withColumn("attack_percentage", pct)


def attack_distribution(df: DataFrame, category: str = "category", severity: str = "severity") -> DataFrame:
    """AGG17L distributions over attack rows: (kind, name, count); a missing
    severity counts as Medium."""
    a = df.filter(F.col(category) != C.NORMAL_LABEL)
    cats = a.groupBy(F.lit("category").alias("kind"), F.col(category).alias("name")).agg(
        F.count(F.lit(1)).alias("count"))
    sevs = a.groupBy(F.lit("severity").alias("kind"),
                     F.coalesce(F.col(severity), F.lit(C.LEGACY_SEVERITY_DEFAULT)).alias("name")).agg(
        F.count(F.lit(1)).alias("count"))
    return cats.unionByName(sevs)


def normalize_timestamps(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """TS9L as a frame operator: adds ``normalized_timestamp`` (TIMESTAMP_NTZ, UTC)."""
    from logsight.functions.timestamps import ntz_from_seconds
    if column not in df.columns:
        return df
    return df.withColumn("normalized_timestamp", ntz_from_seconds(legacy_normalise_timestamp(column)))


def preprocess_data(df: DataFrame, now: str, order_col: str = "line_number") -> DataFrame:
    """PIPE1L: full-row dedupe (keep first) -> legacy timestamps -> generic fill
    (``now`` fills missing timestamps; it is a parameter, not the wall clock)."""
    # full-row duplicates compare every column, the line number included (so a
    # log frame never loses a line); the line number still orders keep-first
    deduped = remove_duplicates(df, list(df.columns), order_col)
    return fill_missing_generic(normalize_timestamps(deduped), "fill", now)


def preprocessing_stats(original: DataFrame, processed: DataFrame) -> DataFrame:
    """AGG18L: original vs processed row counts, their difference, the columns."""
    a = original.agg(F.count(F.lit(1)).alias("original_rows")).withColumn("_k", F.lit(1))
    b = processed.agg(F.count(F.lit(1)).alias("processed_rows")).withColumn("_k", F.lit(1))
    # two one-row aggregates
    return (a.join(b, "_k").drop("_k")
             .withColumn("duplicates_removed", F.col("original_rows") - F.col("processed_rows"))
             .withColumn("columns", F.array(*[F.lit(c) for c in processed.columns])))
