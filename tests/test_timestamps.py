"""Timestamp routes; results do not depend on the session time zone."""
from pyspark.sql import functions as F

from logsight.functions.timestamps import format_seconds, normalise_timestamp


def _norm(spark, values, year=2026):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    rows = df.select("i", format_seconds(normalise_timestamp("raw", year)).alias("t")).orderBy("i").collect()
    return [r["t"] for r in rows]


def test_mixed_formats(spark):
    out = _norm(spark, ["2026-08-14 10:22:31", "2026-08-14T10:22:31", "Aug 14 10:22:31", "1786011751", "", None])
    assert out[0] == "2026-08-14 10:22:31"
    assert out[1] == "2026-08-14 10:22:31"
    assert out[2] == "2026-08-14 10:22:31"
    assert out[3] is not None
    assert out[4] is None and out[5] is None


def test_offsets_to_utc(spark):
    out = _norm(spark, ["14/Aug/2026:10:22:31 +0200", "2026-08-14T10:22:31+02:00", "2026-08-14 10:22:31,999",
                        "14 Aug 2026 10:22:31"])
    assert out == ["2026-08-14 08:22:31", "2026-08-14 08:22:31", "2026-08-14 10:22:31", "2026-08-14 10:22:31"]


def test_feb29_needs_leap_year_and_epoch_bounds(spark):
    assert _norm(spark, ["Feb 29 10:00:00"], year=2025) == [None]
    assert _norm(spark, ["Feb 29 10:00:00"], year=2028) == ["2028-02-29 10:00:00"]
    # 13-digit epoch millis are outside the seconds route
    assert _norm(spark, ["1755171751000"]) == [None]


def test_unparsable_count(spark):
    df = spark.createDataFrame([("2026-08-14 10:22:31",), ("not a time",), ("",)], "raw string")
    n = df.agg(F.count_if((F.trim("raw") != "") & normalise_timestamp("raw").isNull())).first()[0]
    assert n == 1


FREE = {  # text -> what it means in UTC (None: no time)
    "Friday, August 14, 2026 10:22:31 PM": "2026-08-14 22:22:31", "14-Aug-26": "2026-08-14 00:00:00", "20260814T102231Z": "2026-08-14 10:22:31",
    "Fri Aug 14 10:22:31 UTC 2026": "2026-08-14 10:22:31", "10:22 am August 14 2026": "2026-08-14 10:22:00", "Aug 2026": "2026-08-01 00:00:00",
    "August 14th 2026": "2026-08-14 00:00:00", "12 am Aug 3 2026": "2026-08-03 00:00:00", "12 PM Aug 3 2026": "2026-08-03 12:00:00",
    "2026-08-14 10:22:31 +05:30": "2026-08-14 04:52:31", "14.08.2026 10:22": "2026-08-14 10:22:00", "1/2/3": "2003-01-02 00:00:00",
    "99-01-02": "1999-01-02 00:00:00", "14/08/2026": "2026-08-14 00:00:00", "08/14/2026": "2026-08-14 00:00:00", "260814": "2014-08-26 00:00:00",
    "20260814102231": "2026-08-14 10:22:31", "Sept 3, 2026": "2026-09-03 00:00:00", "2024 Feb 29": "2024-02-29 00:00:00",
    "2026-13-45 10:00:00": None, "Feb 30 2026": None, "13:00 pm Aug 4 2026": None, "2026-08-14 24:00:00": None, "12:99 Aug 4 2026": None,
    "x 2026-08-14": None, "hello 12": None, "Aug 14": None, "10:22": None, "2026-08-14 10:22 EST": None, "": None, "a b c": None,
    "1" * 70: None, "2026-08-14 10:22 10:23": None, "Fri Sat Aug 14 2026": None, "2026--": "2026-01-01 00:00:00", "é 2026": None, "2026-08-14 10:22:31 +99:99": None,
}


def test_free_form(spark):
    from pyspark.sql import functions as F

    from logsight.functions.freeform import free_form_seconds
    from logsight.functions.timestamps import format_seconds
    rows = spark.createDataFrame([(t,) for t in FREE] + [(None,)], "t string")
    got = rows.select("t", format_seconds(free_form_seconds(F.col("t"), 2026)).alias("s")).collect()
    assert {r.t: r.s for r in got} == FREE | {None: None}
