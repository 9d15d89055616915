"""Cleaning: duplicates, timestamp normalisation, missing values, text copies.

``preprocess`` is the whole cleaning pass (DD1 -> TS1 -> PRJ7 -> STR1/2 ->
behavioural features); ``cleaning_report`` is its one-row summary.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsight.functions.text import clean_text, url_decode_lenient
from logsight.functions.timestamps import ntz_from_seconds, with_ts_seconds
from logsight.session import stage

KEY_COLUMNS = ("ts_raw", "src_ip", "event")
# Canonical columns a hand-built frame may lack, with their type.
_DEFAULTS = {
    "ts_raw": "string", "src_ip": "string", "dst_ip": "string", "dst_port": "double",
    "username": "string", "event": "string", "bytes": "double", "duration": "double",
    "status": "string", "label_original": "string",
}
MISSING_COLUMNS = ("timestamp", "src_ip", "dst_port", "username", "event", "bytes", "duration")


def ensure_canonical(df: DataFrame) -> DataFrame:
    """Add absent canonical columns as typed nulls."""
    for name, typ in _DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(typ))
    return df


def _identity_columns(df: DataFrame, extra_exclude=()) -> list[str]:
    skip = {"row_id", "format", "host", "prog", *extra_exclude}
    return [c for c in df.columns if c not in skip]


def _dup_key(df: DataFrame) -> list:
    """Duplicate key: rows with raw timestamp and event compare on
    (ts_raw, src_ip, event); other rows compare on every column but row_id."""
    keyed = F.col("ts_raw").isNotNull() & F.col("event").isNotNull()
    others = F.struct(*[F.col(c) for c in _identity_columns(df)])
    return [keyed.alias("_keyed"), F.col("ts_raw").alias("_k_ts"), F.col("src_ip").alias("_k_ip"),
            F.col("event").alias("_k_ev"), F.when(~keyed, others).alias("_k_rest")]


_KEYS = ["_keyed", "_k_ts", "_k_ip", "_k_ev", "_k_rest"]


def duplicate_groups(df: DataFrame, order_col: str = "row_id") -> DataFrame:
    """The duplicate keys that occur twice or more, with the first row id and
    the number of rows. A grouped ``min`` (partial aggregation map-side): a
    hot key collapses before the shuffle."""
    return (df.select(*_dup_key(df), F.col(order_col).alias("_o")).groupBy(*_KEYS)
            .agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))


def flag_duplicates(df: DataFrame, order_col: str = "row_id") -> DataFrame:
    """Add ``is_duplicate`` (an earlier row has the same key). The few repeated
    keys are joined back by key, so rows never multiply."""
    groups = duplicate_groups(df, order_col)
    groups = groups.select(*[F.col(k).alias(f"{k}_g") for k in _KEYS], "_first")
    keyed = df.select("*", *_dup_key(df))
    same = F.lit(True)
    for k in _KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_g"))
    flag = F.coalesce(F.col(order_col) > F.col("_first"), F.lit(False))
    return keyed.join(groups, same, "left").select(*df.columns, flag.alias("is_duplicate"))


def dedupe_events(df: DataFrame, order_col: str = "row_id") -> DataFrame:
    """Keep the first row of every duplicate group (DD1).

    One grouped ``min_by(row, row_id)``: each map task keeps one row per
    key before the shuffle (a hot key collapses early), and the surviving
    rows come out of the aggregate itself — one shuffle, no join back."""
    cols = df.columns
    return (df.select(*_dup_key(df), F.struct(*cols).alias("_row"), F.col(order_col).alias("_o"))
              .groupBy("_keyed", "_k_ts", "_k_ip", "_k_ev", "_k_rest")
              .agg(F.min_by("_row", "_o").alias("_row"))
              .select("_row.*"))


def fill_missing(df: DataFrame) -> DataFrame:
    """src_ip/dst_ip -> 'unknown'; username/event/status -> ''; numbers stay null."""
    return df.na.fill({"src_ip": "unknown", "dst_ip": "unknown", "username": "",
                       "event": "", "status": ""})


def add_text_columns(df: DataFrame) -> DataFrame:
    """event_decoded (lenient URL decode) and
    event_clean (lower-cased, whitespace collapsed), both of the whole text."""
    return (df.withColumn("event_decoded", url_decode_lenient("event"))
              .withColumn("event_clean", clean_text("event_decoded")))


def normalise(df: DataFrame, assume_year: int | None = None) -> DataFrame:
    """Add ts_sec (BIGINT, UTC) and timestamp (TIMESTAMP_NTZ) from ts_raw."""
    out = with_ts_seconds(df, "ts_raw", "ts_sec", assume_year)
    return out.withColumn("timestamp", ntz_from_seconds("ts_sec"))


def preprocess(events: DataFrame, assume_year: int | None = None,
               with_features: bool = True) -> DataFrame:
    """The full cleaning pass over canonical events (PIPE1)."""
    from logsight.operators.features import add_behavioural_features

    # the input (typically a parse) is read once, by the dedupe aggregate
    df = dedupe_events(ensure_canonical(events))
    df = normalise(df, assume_year)
    df = add_text_columns(fill_missing(df))
    if not with_features:
        return df
    # the features read the cleaned rows three times (two aggregates and the
    # join back): stage them once rather than re-running the dedupe each time
    return add_behavioural_features(stage(df, "clean-base"))


FILLED_COLUMNS = ("src_ip", "username", "dst_port", "bytes", "duration")


def cleaning_report(events: DataFrame, assume_year: int | None = None) -> DataFrame:
    """One-row summary of the cleaning pass (AGG12): rows in/out, duplicates
    removed, unparsable and normalised timestamps, missing values before
    filling and what filling replaces. One pass: the grouped dedupe carries
    the size of each group along with its first row."""
    df = ensure_canonical(events)
    cols = df.columns
    kept = (df.select(*_dup_key(df), F.struct(*cols).alias("_row"), F.col("row_id").alias("_o"))
              .groupBy(*_KEYS).agg(F.min_by("_row", "_o").alias("_row"), F.count(F.lit(1)).alias("_n"))
              .select("_row.*", "_n"))
    df = normalise(kept, assume_year)
    raw_text = F.regexp_replace(F.coalesce(F.col("ts_raw"), F.lit("")), r"^\s+|\s+$", "")

    def missing(c):
        return F.count_if(F.col("ts_sec" if c == "timestamp" else c).isNull())

    return df.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates_removed"),
        F.count_if((raw_text != "") & F.col("ts_sec").isNull()).alias("unparsable_timestamps"),
        F.count_if(F.col("ts_sec").isNotNull()).alias("timestamps_normalised"),
        *[missing(c).alias(f"missing_{c}") for c in MISSING_COLUMNS],
        *[missing(c).alias(f"filled_{c}") for c in FILLED_COLUMNS],
        F.count(F.lit(1)).alias("rows_out"))
