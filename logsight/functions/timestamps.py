"""Timestamp normalisation as Column expressions.

Every parse attaches an explicit zone (UTC for zone-less text) so results do
not depend on ``spark.sql.session.timeZone``. The canonical result is
``ts_sec`` (BIGINT seconds since the epoch, floored); ``TIMESTAMP_NTZ`` and
text forms are derived from it.

Routes, mutually exclusive, in this order:

* epoch: text that parses as a number in [1e9, 1e11] -> seconds;
* no-year syslog ``Mon d hh:mm:ss`` -> ``assume_year`` (Feb 29 of a non-leap
  year is null);
* apache ``d/Mon/yyyy:hh:mm:ss +zzzz`` -> offset honoured;
* direct: first the frequent formats, each with its own pattern:
  ISO-8601 date or date-time (``T`` or space, ``.``/``,`` fraction, optional
  ``Z``/``+hh:mm``/``+hhmm``/``+hh`` zone), and those of DIRECT_FORMATS, with
  a weekday before (``Fri, 14 Aug 2026 10:22:31 +0000``) or a zone after (``UTC``, ``GMT``, an
  offset, a blank before it or not) where they have a time; all other texts go
  through the token-class automaton of ``freeform``;
* on request (``epoch_millis``) a number in [1e12, 1e14] is milliseconds.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.functions.freeform import free_form_seconds
from logsight.functions.text import _c, let, strip_ws

ISO_DIRECT_RE = (r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)?"
                 r"(Z|[+-]\d{2}(?::?\d{2})?)?$")
# (regex guard of the text without zone or weekday, Spark pattern)
DIRECT_FORMATS = (
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}:\d{2}$", "d MMM yyyy H:mm:ss"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4} \d{1,2}:\d{2}:\d{2}$", "MMM d yyyy H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$", "M/d/yyyy h:mm:ss a"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AP]M$", "M/d/yyyy h:mm a"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^(?:19|20)\d{6}$", "yyyyMMdd"),
)
ZONE_RE = r"\s*(?:UTC|GMT|Z|[+-]\d{2}:?\d{2})$"


def ntz_from_seconds(sec: Column | str) -> Column:
    """BIGINT epoch seconds -> TIMESTAMP_NTZ holding the UTC wall clock."""
    # a typed SQL literal: a Python datetime literal would pass through the
    # session time zone
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _c(sec))


def format_seconds(sec: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ntz_from_seconds(sec), fmt)


def _squash(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def _iso_seconds(text: Column) -> Column:
    dotted = F.replace(text, F.lit(","), F.lit("."))
    has_time = text.contains("T") | text.contains(" ")
    has_zone = text.endswith("Z") | text.rlike(r"\d[+-]\d{2}(?::?\d{2})?$")
    zoned = F.when(has_zone, dotted).otherwise(F.concat(dotted, F.lit("Z")))
    # date-only text: the UTC midnight of that date
    return F.when(has_time, F.unix_seconds(zoned.try_cast("timestamp"))).otherwise(
        F.unix_date(text.try_cast("date")).cast("bigint") * 86400)


def normalise_timestamp(raw: Column | str, assume_year: int | None = None, epoch_millis: bool = False) -> Column:
    """Raw timestamp text -> BIGINT seconds (UTC), null when unparsable.

    For wide plans prefer :func:`with_ts_seconds`, which materialises the
    trimmed text once instead of re-deriving it in every route."""
    return let(strip_ws(F.coalesce(_c(raw).cast("string"), F.lit(""))),
               lambda t: _normalise_stripped(t, assume_year, epoch_millis))


def with_ts_seconds(df: DataFrame, raw: str = "ts_raw", out: str = "ts_sec",
                    assume_year: int | None = None) -> DataFrame:
    """Add ``out`` = :func:`normalise_timestamp` of column ``raw``."""
    return df.withColumn(out, normalise_timestamp(raw, assume_year))


def _direct(text: Column) -> Column:
    """The other formats: the zone, if any, apart from the rest."""
    zone = F.regexp_replace(F.regexp_extract(text, ZONE_RE, 0), r"[\s:]", "")
    offset = F.when(zone.isin("", "UTC", "GMT", "Z"), F.lit("+0000")).otherwise(zone)
    plain = F.regexp_replace(F.regexp_replace(text, ZONE_RE, ""), r"^[A-Za-z]{3},\s+", "")

    def parsed(b):
        out = F.lit(None).cast("bigint")
        for guard, fmt in reversed(DIRECT_FORMATS):
            ts = F.try_to_timestamp(F.concat(b["p"], F.lit(" "), b["z"]), F.lit(fmt + " Z"))
            out = F.when(b["p"].rlike(guard), F.unix_seconds(ts)).otherwise(out)
        return out

    return let(F.struct(_squash(F.replace(plain, F.lit(","), F.lit(""))).alias("p"), offset.alias("z")), parsed)


def _normalise_stripped(text: Column, assume_year: int | None, epoch_millis: bool = False) -> Column:
    year = assume_year if assume_year is not None else _dt.date.today().year
    num = text.try_cast("double")
    is_epoch = num.between(C.EPOCH_MIN, C.EPOCH_MAX)
    # each route's regex runs only when the text has what the route needs
    first = F.upper(F.substring(text, 1, 1))
    noyear = first.between("A", "Z") & text.rlike(C.NOYEAR_TS_RE)
    apache = text.contains("/") & text.rlike(C.APACHE_TS_RE)
    noyear_sec = F.unix_seconds(F.try_to_timestamp(
        F.concat(F.lit(f"{year} "), _squash(text), F.lit(" +0000")), F.lit("yyyy MMM d HH:mm:ss Z")))
    apache_sec = F.unix_seconds(F.try_to_timestamp(_squash(text), F.lit("d/MMM/yyyy:HH:mm:ss Z")))
    # "2026-08-14 10:22:31 UTC" and "... +0000" are ISO once the blank is gone
    iso = F.regexp_replace(F.regexp_replace(text, r"\s*(?:UTC|GMT)$", "Z"), r"\s+([+-]\d{2}:?\d{2})$", "$1")
    direct = F.when(F.substring(text, 5, 1) == "-", let(iso, lambda t: F.when(t.rlike(ISO_DIRECT_RE), _iso_seconds(t))))
    direct = F.coalesce(direct.otherwise(_direct(text)), free_form_seconds(text, year))
    out = F.when(text == "", F.lit(None).cast("bigint"))
    if epoch_millis:
        out = out.when(num.between(1e12, 1e14), F.floor(num / 1000).cast("bigint"))
    return (out.when(is_epoch, F.floor(num).cast("bigint"))
            .when(noyear, noyear_sec)
            .when(apache, apache_sec)
            .otherwise(direct))


def legacy_normalise_timestamp(raw: Column | str) -> Column:
    """Legacy rule: explicit formats in order, then an ISO fallback; no-year
    text gets year 1900 (the strptime default). Returns BIGINT seconds.

    A format is tried where the text has the characters that it cannot do
    without (a failed try costs an exception); letters in either case, as the formats take them."""
    text = strip_ws(_c(raw).cast("string"))
    tries = []
    for fmt in C.LEGACY_TS_FORMATS:
        if fmt == "MMM dd HH:mm:ss":
            may = F.upper(F.substring(text, 1, 1)).between("A", "Z")
            ts = F.try_to_timestamp(F.concat(F.lit("1900 "), text, F.lit(" +0000")),
                                    F.lit("yyyy MMM d HH:mm:ss Z"))
        else:
            needs = [c for c in ("/", ".") if c in fmt] + ([] if "/" in fmt else ["-"])
            may = text.contains("T") | text.contains("t") if "'T'" in fmt else text.contains(" ")
            for c in needs:
                may = may & text.contains(c)
            if fmt.endswith("Z") or fmt.endswith("XX"):
                ts = F.try_to_timestamp(text, F.lit(fmt))
            else:
                ts = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(fmt + " Z"))
        tries.append(F.when(may, F.unix_seconds(ts)))
    tries.append(F.when(text.rlike(ISO_DIRECT_RE), _iso_seconds(text)))
    return F.coalesce(*tries)


def calendar_features(sec: Column | str) -> dict[str, Column]:
    """hour, day_of_week (Monday=0), is_weekend; null timestamp -> 0 each."""
    ts = ntz_from_seconds(sec)
    hour = F.coalesce(F.hour(ts), F.lit(0))
    dow = F.coalesce(F.weekday(ts), F.lit(0))
    return {"hour": hour, "day_of_week": dow, "is_weekend": (dow >= 5).cast("int")}
