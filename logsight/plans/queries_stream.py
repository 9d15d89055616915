"""Catalogue: Structured Streaming extension (STM1-STM5).

Inputs are written by Spark from the driver tables into the shared stage
folder (text lines / scored parquet) as four deliveries in order of time, some
rows late, some twice; each delivery is a micro-batch of ``readStream``. The
SQL twins state the watermark rule: what comes behind the watermark is dropped, and a
window is emitted once the watermark has passed its end."""
from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from logsight import constants as C
from logsight.operators.severity import apply_confidence_floor
from logsight.plans import sql_blocks as S
from logsight.plans.catalog import register
from logsight.plans.inputs import FIXTURE_YEAR
from logsight.session import ensure_checkpoint_dir, read_table, stage
from logsight.sources.fixtures import REPEAT, SEC_EXPR, log_lines, scored_events
from logsight.streaming import streams as ST


def _stage_dir(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/logsight-stage/{name}-{uuid.uuid4().hex}"


SLICES, DELAY, LATE = 4, 600, 97  # deliveries, watermark in seconds, every n-th early row is late
FILES, FILE_ROWS = 2, 250_000  # files of a delivery: two at least, more as its rows grow


def _deliver(df, name, columns, write):
    """Write rows as several deliveries in order of time, one after the other,
    as a source would bring them. Every LATE-th row of the first delivery
    comes with the last one, far behind the watermark. Returns the folder and
    the number of files of each delivery."""
    spark, path = df.sparkSession, _stage_dir(df.sparkSession, name)
    staged = stage(df, name)
    lo, hi, rows = staged.agg(F.min("sec"), F.max("sec"), F.count(F.lit(1))).first()
    files = max(FILES, math.ceil(rows / SLICES / FILE_ROWS))
    own = F.least(F.lit(SLICES - 1), F.floor((F.col("sec") - lo) * SLICES / (hi - lo + 1)))
    late = (own == 0) & (F.col("row_id") % LATE == 0)
    placed = staged.withColumn("_slice", F.when(late, SLICES - 1).otherwise(own))
    for k in range(SLICES):
        part = placed.filter(F.col("_slice") == k).repartition(files)
        write(part.select(*columns), f"{path}/{k}")
    return path, files


def _line_stream(spark, sf_dir):
    lines = log_lines(spark, sf_dir).withColumn("event_id", F.col("row_id") % REPEAT).join(
        read_table(spark, sf_dir, "events").selectExpr("event_id", f"{SEC_EXPR} AS sec"), "event_id")
    # every tenth line is delivered twice
    twice = lines.unionByName(lines.filter("row_id % 10 = 0"))
    path, files = _deliver(twice, "stream-lines", ["value"], lambda df, p: df.write.text(p))
    source = spark.readStream.option("maxFilesPerTrigger", files).text(f"{path}/*")
    return ST.stream_events(source, FIXTURE_YEAR)


def _slice_sql(source, span=None):
    """CTE ``arr``: rows with their delivery and the watermarks (``w_last`` before the last one, ``w_end`` after all)."""
    return f"""sp AS ({span or f'SELECT min(ts_sec) AS lo, max(ts_sec) AS hi FROM {source}'}),
own AS (SELECT s.*, least({SLICES - 1}, CAST(floor((ts_sec - lo) * {SLICES} / (hi - lo + 1)) AS BIGINT)) AS sl FROM {source} s, sp),
pl AS (SELECT *, sl = 0 AND row_id % {LATE} = 0 AS late FROM own),
arr AS (SELECT *, (SELECT max(ts_sec) FROM pl WHERE sl < {SLICES - 1} AND NOT late) - {DELAY} AS w_last,
               (SELECT max(ts_sec) FROM pl) - {DELAY} AS w_end FROM pl)"""


_EV_SQL = f"""WITH {S.LINES_CTE},
{S.parsed_cte()},
ev1 AS (SELECT row_id, format, ts_raw, coalesce(src_ip, 'unknown') AS src_ip, coalesce(username, '') AS username,
              coalesce(event, '') AS event, {S.ts_seconds_sql('ts_raw', FIXTURE_YEAR)} AS ts_sec,
              {S.any_token_sql(S.clean_sql(S.url_decode_sql("coalesce(event, '')")), C.FAIL_WORDS)} AS is_failure
       FROM parsed),
ev AS (SELECT * FROM ev1 UNION ALL SELECT * FROM ev1 WHERE row_id % 10 = 0),
{_slice_sql('ev', 'SELECT min(sec) AS lo, max(sec) AS hi FROM lines_c')}"""


@register("stream_parse", f"{_EV_SQL}\nSELECT format, ts_raw, src_ip, username, event, ts_sec FROM ev")
def q_stream_parse(spark, sf_dir):
    """STM1: stateless parse/normalise/clean of a text stream."""
    ev = _line_stream(spark, sf_dir).select("format", "ts_raw", "src_ip", "username", "event", "ts_sec")
    return ST.run_available(ev, "parse")


@register("stream_dedupe", f"""{_EV_SQL}
SELECT DISTINCT ts_raw, src_ip, event, ts_sec FROM arr WHERE ts_sec IS NOT NULL AND (NOT late OR ts_sec > w_last)""")
def q_stream_dedupe(spark, sf_dir):
    """STM2: keyed duplicates dropped within the watermark; rows behind it are dropped too."""
    ev = ST.stream_dedupe(_line_stream(spark, sf_dir)).select("ts_raw", "src_ip", "event", "ts_sec")
    return ST.run_available(ev, "dedupe")


@register("stream_dedupe_whole", f"""{_EV_SQL}
SELECT DISTINCT ts_raw, src_ip, event, ts_sec FROM ev""")
def q_stream_dedupe_whole(spark, sf_dir):
    """STM2 / DD1(b) across deliveries without losing rows: late rows and rows without a readable time are kept once."""
    ev = _line_stream(spark, sf_dir).select("ts_raw", "src_ip", "event", "ts_sec")
    return ST.run_deduped(ev)


@register("stream_ip_rate", f"""{_EV_SQL},
w AS (SELECT src_ip, late, w_last, w_end, (ts_sec // 10) * 10 - 10 * k AS window_start FROM arr, range(0, 6) AS r(k)
      WHERE ts_sec IS NOT NULL)
SELECT src_ip, window_start, count(*) AS n FROM w
WHERE (NOT late OR window_start + 60 > w_last) AND window_start + 60 <= w_end GROUP BY ALL""")
def q_stream_ip_rate(spark, sf_dir):
    """STM4: per-IP sliding 60 s / 10 s counts of the windows that the watermark has passed."""
    return ST.run_available(ST.stream_ip_rate(_line_stream(spark, sf_dir)), "ip-rate")


@register("stream_bursts", f"""{_EV_SQL},
c AS (SELECT src_ip, ts_sec, count(*) AS n, count(*) FILTER (WHERE is_failure) AS f, any_value(w_end) AS w_end
      FROM arr WHERE ts_sec IS NOT NULL AND (NOT late OR ts_sec + 30 > w_last) GROUP BY src_ip, ts_sec),
o AS (SELECT *, CASE WHEN ts_sec - lag(ts_sec) OVER (PARTITION BY src_ip ORDER BY ts_sec) <= 30 THEN 0 ELSE 1 END AS new_s FROM c),
g AS (SELECT *, sum(new_s) OVER (PARTITION BY src_ip ORDER BY ts_sec) AS sid FROM o)
SELECT src_ip, min(ts_sec) AS session_start, max(ts_sec) + 30 AS session_end, CAST(sum(n) AS BIGINT) AS events,
       CAST(sum(f) AS BIGINT) AS failures FROM g GROUP BY src_ip, sid HAVING max(ts_sec) + 30 <= any_value(w_end)""")
def q_stream_bursts(spark, sf_dir):
    """STM5: per-IP session windows (30 s gap) with failure counts, once the watermark has passed them."""
    return ST.run_available(ST.stream_bursts(_line_stream(spark, sf_dir)), "bursts")


@register("stream_timeline", f"""WITH {S.SCORED_CTE},
{_slice_sql('sc')},
a AS (SELECT * FROM arr WHERE raw_category <> 'Normal' AND round(confidence, 4) >= {C.CONFIDENCE_ANOMALY_THRESHOLD}),
wm AS (SELECT max(ts_sec) FILTER (WHERE sl < {SLICES - 1} AND NOT late) - {DELAY} AS w3, max(ts_sec) - {DELAY} AS w4 FROM a)
SELECT ts_sec - ts_sec % 60 AS window_start, count(*) AS count FROM a, wm
WHERE (NOT late OR ts_sec - ts_sec % 60 + 60 > w3) AND ts_sec - ts_sec % 60 + 60 <= w4 GROUP BY 1""")
def q_stream_timeline(spark, sf_dir):
    """STM3: minute tumbling attack counts from a stream of scored events."""
    sc = scored_events(spark, sf_dir)
    path, files = _deliver(sc.withColumn("sec", F.col("ts_sec")), "stream-scored", sc.columns, lambda df, p: df.write.parquet(p))
    s = spark.readStream.schema(sc.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")
    s = apply_confidence_floor(s.withColumn("predicted_category", F.col("raw_category")))
    s = s.withColumn("event_time", F.timestamp_seconds("ts_sec"))
    return ST.run_available(ST.stream_timeline(s), "timeline")
