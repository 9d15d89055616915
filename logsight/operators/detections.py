"""Detections table API: filter, sort, page (FLT1, SRT1, WIN5).

Filters are plain predicates (they push into the parquet scan of a staged
scored table); no page, first or last, brings more than its own rows together
in one task.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.functions.timestamps import format_seconds
from logsight.operators.severity import severity_rank
from logsight.operators.stats import excerpt
from logsight.session import stage
from logsight.sources.rowid import dense_numbers


def haystack() -> Column:
    """What a search looks through: ``event + ' ' + src_ip + ' ' + username`` in lower case."""
    return F.lower(F.concat(F.coalesce("event", F.lit("")), F.lit(" "), F.coalesce("src_ip", F.lit("")),
                            F.lit(" "), F.coalesce("username", F.lit(""))))


def filter_detections(df: DataFrame, category: str | None = None, severity: str | None = None,
                      query: str | None = None, legacy_all: bool = False) -> DataFrame:
    """is_anomaly rows, optional category / severity equality, and a literal
    case-insensitive substring search over ``event + ' ' + src_ip + ' ' + username``.
    With ``legacy_all`` the value "All" means no filter (FLT1L)."""
    out = df.filter(F.col("is_anomaly"))
    if category and not (legacy_all and category == "All"):
        out = out.filter(F.col("predicted_category") == category)
    if severity and not (legacy_all and severity == "All"):
        out = out.filter(F.col("severity") == severity)
    q = (query or "").strip().lower()
    if q:
        out = out.filter(haystack().contains(q))
    return out


def sort_keys(key: str = "severity", ascending: bool = False, backwards: bool = False) -> list[Column]:
    """SRT1 sort keys; ties always end on row_id ascending. Unknown key: row_id only.
    ``backwards`` gives the same order read from its end."""
    def d(c):
        if backwards:
            return c.desc_nulls_first() if ascending else c.asc_nulls_first()
        return c.asc_nulls_last() if ascending else c.desc_nulls_last()
    if key == "severity":
        keys = [d(severity_rank("severity")), d(F.col("confidence"))]
    elif key == "time":
        keys = [d(F.col("ts_sec"))]
    elif key == "confidence":
        keys = [d(F.col("confidence"))]
    elif key == "src_ip":
        keys = [d(F.col("src_ip"))]
    elif key == "category":
        keys = [d(F.col("predicted_category"))]
    else:
        keys = []
    return keys + [F.col("row_id").desc() if backwards else F.col("row_id").asc()]


#: Pages this near to either end are a top-k of at most so many rows.
END_ROWS = 10_000


def page(df: DataFrame, key: str = "severity", ascending: bool = False, page_no: int = 1,
         per_page: int = C.PAGE_SIZE, event_chars: int | None = None) -> DataFrame:
    """WIN5: one page of the sorted detections with total / page / last_page.
    The page number is clamped to [1, last_page]; ``pos`` is the 1-based rank.

    The filtered rows are staged once. A page among the first or last ``END_ROWS`` rows is a
    bounded top-k of the order or of the reversed order; one between them numbers the rows in
    range partitions (a count per partition, no global sort in one task) and reads those of the page."""
    shown = stage(df.select("row_id", "ts_sec", "src_ip", "username", "predicted_category", "severity", "confidence",
                            "event"), "detections")
    total = shown.count()
    last_page = max(1, math.ceil(total / per_page))
    p = min(max(1, int(page_no or 1)), last_page)
    start = (p - 1) * per_page
    keys = sort_keys(key, ascending)
    # the windows span a top-k of at most END_ROWS rows (or one page, if that is larger)
    if start + per_page <= max(END_ROWS, per_page):
        ranked = shown.orderBy(*keys).limit(start + per_page).withColumn("pos", F.row_number().over(Window.orderBy(*keys)))
        chunk = ranked.filter(F.col("pos") > start)
    elif total - start <= max(END_ROWS, per_page):
        back = sort_keys(key, ascending, backwards=True)
        ranked = shown.orderBy(*back).limit(total - start).withColumn(
            "pos", F.lit(total + 1) - F.row_number().over(Window.orderBy(*back)))
        chunk = ranked.filter(F.col("pos") <= start + per_page)
    else:
        chunk = dense_numbers(shown, keys, "pos").filter(F.col("pos").between(start + 1, start + per_page))
    return chunk.select(
        F.col("pos").cast("bigint").alias("pos"), "row_id", format_seconds("ts_sec").alias("timestamp"), "src_ip",
        F.coalesce("username", F.lit("")).alias("username"),
        F.col("predicted_category").alias("category"), "severity",
        F.round("confidence", 3).alias("confidence"),
        excerpt("event", event_chars).alias("event"),
        F.lit(total).cast("bigint").alias("total"), F.lit(p).cast("bigint").alias("page"),
        F.lit(last_page).cast("bigint").alias("last_page"))
