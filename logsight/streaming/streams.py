"""Structured Streaming forms of the row-local steps (an extension: the batch
library has no streaming input of its own).

* STM1 ``stream_events``: raw log lines -> parsed, normalised, cleaned events
  (stateless; the same Column functions as the batch path).
* STM2 ``stream_dedupe``: keyed duplicates dropped within the watermark;
  ``run_deduped``: over all deliveries, by a written table of keys, no row lost.
* STM3 ``stream_timeline``: 1-minute tumbling attack counts.
* STM4 ``stream_ip_rate``: per-IP sliding 60 s / 10 s counts (the centred
  ±30 s batch rate needs future rows; a stream can only look back).
* STM5 ``stream_bursts``: per-IP session windows (30 s gap) with failures.

All but ``run_deduped`` run in append mode: the watermark frees their state, and rows
behind it are dropped. ``run_available`` drives a query to completion
(``availableNow``) into a parquet file sink. Sessions of a hot key are merged
before the shuffle where ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is on.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.functions.lineparse import parse_lines
from logsight.functions.text import clean_text, has_any_token, url_decode_lenient
from logsight.functions.timestamps import normalise_timestamp
from logsight.session import ensure_checkpoint_dir

WATERMARK = "10 minutes"


def stream_events(lines: DataFrame, assume_year: int | None = None) -> DataFrame:
    """STM1 over a streaming DataFrame with a ``value`` column."""
    p = parse_lines(lines)
    return (p.withColumn("ts_sec", normalise_timestamp("ts_raw", assume_year))
             .withColumn("event_time", F.timestamp_seconds("ts_sec"))
             .withColumn("src_ip", F.coalesce("src_ip", F.lit("unknown")))
             .withColumn("username", F.coalesce("username", F.lit("")))
             .withColumn("event", F.coalesce("event", F.lit("")))
             .withColumn("event_clean", clean_text(url_decode_lenient("event")))
             .withColumn("is_failure", has_any_token("event_clean", C.FAIL_WORDS)))


def stream_dedupe(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """STM2: keyed duplicates (raw timestamp, src_ip, event) dropped while
    the watermark still holds their key. Rows without a readable time have no
    place in event time and are left out."""
    return (events.filter(F.col("event_time").isNotNull()).withWatermark("event_time", delay)
                  .dropDuplicatesWithinWatermark(["ts_raw", "src_ip", "event"]))


KEY_BUCKETS = 64


def merge_delivery(batch: DataFrame, number: int, store: str, keys: tuple[str, ...]) -> None:
    """One delivery of ``run_deduped``: its rows whose key neither it nor an earlier delivery has had go to
    ``rows/delivery=<number>``, their digests to ``keys/delivery=<number>`` (by bucket). Both folders belong
    to the delivery and are overwritten, and only earlier ones are read, so a delivery
    that is tried again leaves the same keys once.

    The keys are SHA-256 digests of the key columns as JSON (nulls left out, so null is not the empty text).
    The key table is only scanned: it is cut down to the keys of this delivery by a semi join, whose other side is
    the delivery's digests (broadcast by AQE or filtered by bucket when small); only what is left meets the rows."""
    spark = batch.sparkSession
    digest = F.unhex(F.sha2(F.to_json(F.struct(*keys)), 256))
    bucket = F.pmod(F.xxhash64("_digest"), F.lit(KEY_BUCKETS)).cast("int")
    one = batch.dropDuplicates(list(keys)).withColumn("_digest", digest).withColumn("_bucket", bucket)
    one.write.mode("overwrite").parquet(f"{store}/inbox")
    one = spark.read.schema(one.schema).parquet(f"{store}/inbox")
    on = ["_bucket", "_digest"]
    fresh = one
    if number > 0:
        known = (spark.read.schema("_digest binary, _bucket int, delivery long").option("basePath", f"{store}/keys")
                 .parquet(f"{store}/keys").filter(F.col("delivery") < number))
        fresh = one.join(known.join(one.select(*on), on, "left_semi").select(*on), on, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{store}/rows/delivery={number}")
    kept = spark.read.schema(one.schema).parquet(f"{store}/rows/delivery={number}")
    (kept.select(*on).repartition("_bucket").sortWithinPartitions(*on).write.mode("overwrite").partitionBy("_bucket")
         .parquet(f"{store}/keys/delivery={number}"))


def run_deduped(stream: DataFrame, keys: tuple[str, ...] = ("ts_raw", "src_ip", "event"), store: str | None = None) -> DataFrame:
    """STM2 / DD1(b) over any number of deliveries: each key is kept once, whenever its copies come.
    Rows without a readable time are kept once like any other, and rows behind a watermark are kept too:
    what has been seen lies in a written table, not in state that event time frees.

    ``store`` (a folder shared by all executors; a new one if None) holds rows, keys and the checkpoint:
    another run with it goes on where the last one ended. Of rows with one key in one delivery any one is kept.
    Returns all rows kept so far. Nulls equal nulls in keys; an empty delivery adds nothing."""
    spark: SparkSession = stream.sparkSession
    store = store or ensure_checkpoint_dir(spark).rstrip("/") + f"/logsight-stream/deduped-{uuid.uuid4().hex}"
    q = (stream.writeStream.foreachBatch(lambda batch, number: merge_delivery(batch, number, store, keys))
         .option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{store}/rows").select(*stream.columns)


def stream_timeline(scored: DataFrame, delay: str = WATERMARK, width: str = "1 minute") -> DataFrame:
    """STM3: attacks per tumbling window; rows later than the watermark are dropped."""
    attacks = scored.filter(F.col("predicted_category") != C.NORMAL_LABEL)
    return (attacks.withWatermark("event_time", delay)
                   .groupBy(F.window("event_time", width).alias("w"))
                   .agg(F.count(F.lit(1)).alias("count"))
                   .select(F.unix_seconds(F.col("w.start")).alias("window_start"), "count"))


def stream_ip_rate(events: DataFrame, delay: str = WATERMARK, width: str = "60 seconds",
                   slide: str = "10 seconds") -> DataFrame:
    """STM4: per-IP event counts over sliding windows."""
    return (events.withWatermark("event_time", delay)
                  .groupBy("src_ip", F.window("event_time", width, slide).alias("w"))
                  .agg(F.count(F.lit(1)).alias("n"))
                  .select("src_ip", F.unix_seconds(F.col("w.start")).alias("window_start"), "n"))


def stream_bursts(events: DataFrame, delay: str = WATERMARK, gap: str = "30 seconds") -> DataFrame:
    """STM5: per-IP activity sessions with the number of failure events in
    each; events at most ``gap`` apart share a session (touching windows merge)."""
    return (events.withWatermark("event_time", delay)
                  .groupBy("src_ip", F.session_window("event_time", gap).alias("s"))
                  .agg(F.count(F.lit(1)).alias("events"), F.count_if("is_failure").alias("failures"))
                  .select("src_ip", F.unix_seconds(F.col("s.start")).alias("session_start"),
                          F.unix_seconds(F.col("s.end")).alias("session_end"), "events", "failures"))


def run_available(stream: DataFrame, name: str = "stream", out: str | None = None) -> DataFrame:
    """Run ``stream`` over everything available now in append mode, into
    Spark's parquet file sink: its log keeps a batch that is tried again from
    doubling rows. Sink and checkpoint lie in the shared checkpoint folder.
    Returns what was emitted: windows that the watermark has not passed
    stay in the state for the next run."""
    spark: SparkSession = stream.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/logsight-stream/{name}-{uuid.uuid4().hex}"
    out = out or base + "/out"
    q = (stream.writeStream.format("parquet").option("path", out).outputMode("append")
         .option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
