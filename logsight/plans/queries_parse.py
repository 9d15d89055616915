"""Catalogue: line parsing, timestamps, text, cleaning and features."""
from __future__ import annotations

from pyspark.sql import functions as F

from logsight import constants as C
from logsight.functions.text import has_any_token
from logsight.functions.timestamps import format_seconds, with_ts_seconds
from logsight.operators import clean as CL
from logsight.operators import features as FE
from logsight.operators.profile import parse_report
from logsight.plans import sql_blocks as S
from logsight.plans.catalog import register
from logsight.plans.inputs import FIXTURE_YEAR, canonical_lines, clean_lines, parsed_lines
from logsight.session import read_table

PARSE_COLS = ["row_id", "format", "ts_raw", "src_ip", "dst_ip", "dst_port", "username", "event",
              "bytes", "duration", "status", "host", "prog", "parse_ok"]
_PARSE_SQL = f"WITH {S.LINES_CTE},\n{S.parsed_cte()}\nSELECT {', '.join(PARSE_COLS)} FROM parsed"


@register("parse_lines", _PARSE_SQL)
def q_parse_lines(spark, sf_dir):
    """LP1-LP12 over every fixture line."""
    return parsed_lines(spark, sf_dir).select(*PARSE_COLS)


def _by_format(fmt):
    def q(spark, sf_dir):
        return parsed_lines(spark, sf_dir).filter(F.col("format") == fmt).select(*PARSE_COLS)
    q.__doc__ = f"LP*: lines detected as {fmt}."
    return q


for _fmt in ("syslog", "apache", "iso", "generic"):
    register(f"parse_{_fmt}", f"{_PARSE_SQL} WHERE format = '{_fmt}'")(_by_format(_fmt))


@register("parse_report", f"""WITH {S.LINES_CTE},
{S.parsed_cte()}
SELECT coalesce(format, '*') AS format, count(*) AS lines,
       CAST(sum(CASE WHEN parse_ok THEN 1 ELSE 0 END) AS BIGINT) AS ok_lines,
       CAST(sum(CASE WHEN ts_raw IS NULL AND src_ip IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS failed_lines,
       round(avg(CASE WHEN parse_ok THEN 1.0 ELSE 0.0 END), 4) AS success_rate,
       round(avg(CASE WHEN parse_ok THEN 1.0 ELSE 0.0 END), 4) >= 0.95 AS meets_target
FROM parsed GROUP BY ROLLUP (format)""")
def q_parse_report(spark, sf_dir):
    """AGG11: lines per detected format and overall ('*'), success rate (4 dp)."""
    return parse_report(parsed_lines(spark, sf_dir))


_TS_FORMATS = (  # (Spark pattern, strftime pattern, suffix, seconds kept)
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", " +0000", 1), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", " UTC", 1),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "Z", 1), ("MM/dd/yyyy HH:mm", "%m/%d/%Y %H:%M", "", 60),
    ("M/d/yyyy hh:mm:ss a", "%-m/%-d/%Y %I:%M:%S %p", "", 1), ("MMM d yyyy HH:mm:ss", "%b %-d %Y %H:%M:%S", "", 1),
    ("EEE, d MMM yyyy HH:mm:ss", "%a, %-d %b %Y %H:%M:%S", " +0000", 1), ("yyyyMMdd", "%Y%m%d", "", 86400),
    ("d MMM yyyy HH:mm:ss", "%-d %b %Y %H:%M:%S", "", 1), ("yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S", "", 1),
    ("MM/dd/yyyy", "%m/%d/%Y", "", 86400), ("dd/MMM/yyyy:HH:mm:ss", "%d/%b/%Y:%H:%M:%S", " +0000", 1),
)


@register("timestamp_formats", f"""SELECT event_id AS row_id, CASE event_id % {len(_TS_FORMATS)} """ + " ".join(
    f"WHEN {i} THEN concat(strftime(ts, {S.q(f)}), {S.q(z)})" for i, (_, f, z, _) in enumerate(_TS_FORMATS))
    + f""" END AS ts_raw, CAST(CASE event_id % {len(_TS_FORMATS)} """ + " ".join(
    f"WHEN {i} THEN floor(epoch(ts)) - floor(epoch(ts)) % {k}" for i, (_, _, _, k) in enumerate(_TS_FORMATS))
    + " END AS BIGINT) AS ts_sec FROM events")
def q_timestamp_formats(spark, sf_dir):
    """TS5: the event times written in a dozen ways, read back to seconds."""
    ev = read_table(spark, sf_dir, "events").selectExpr("event_id AS row_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts")
    raw = F.lit(None).cast("string")
    for i, (fmt, _, zone, _) in enumerate(_TS_FORMATS):
        raw = F.when(F.col("row_id") % len(_TS_FORMATS) == i, F.concat(F.date_format("ts", fmt), F.lit(zone))).otherwise(raw)
    return with_ts_seconds(ev.select("row_id", raw.alias("ts_raw")), "ts_raw", "ts_sec", FIXTURE_YEAR)


_FREE_FORMS = (  # (Spark pattern, strftime pattern, before, after, kept: seconds or a unit, seconds east, changed case)
    ("EEEE, MMMM d, yyyy h:mm:ss a", "%A, %B %-d, %Y %-I:%M:%S %p", "", "", 1, 0, ""), ("MMMM d, yyyy HH:mm", "%B %-d, %Y %H:%M", "", "", 60, 0, ""),
    ("d MMMM yyyy HH:mm:ss", "%-d %B %Y %H:%M:%S", "", "", 1, 0, ""), ("MMM d, yyyy", "%b %-d, %Y", "", "", "day", 0, ""),
    ("d-MMM-yyyy HH:mm:ss", "%-d-%b-%Y %H:%M:%S", "", "", 1, 0, ""), ("d-MMM-yy", "%-d-%b-%y", "", "", "day", 0, ""),
    ("yyyy.MM.dd HH:mm:ss", "%Y.%m.%d %H:%M:%S", "", "", 1, 0, ""), ("yyyyMMdd'T'HHmmss", "%Y%m%dT%H%M%S", "", "Z", 1, 0, ""),
    ("yyyyMMddHHmmss", "%Y%m%d%H%M%S", "", "", 1, 0, ""), ("MM/dd/yy HH:mm", "%m/%d/%y %H:%M", "", "", 60, 0, ""),
    ("yyyy-MM-dd'T'HH:mm", "%Y-%m-%dT%H:%M", "", "", 60, 0, "lower"), ("yyyy/M/d h:mm a", "%Y/%-m/%-d %-I:%M %p", "", "", 60, 0, "lower"),
    ("yyyy MMM d HH:mm:ss", "%Y %b %-d %H:%M:%S", "", "", 1, 0, ""), ("EEE MMM d HH:mm:ss yyyy", "%a %b %-d %H:%M:%S %Y", "", "", 1, 0, ""),
    ("EEE MMM d HH:mm:ss 'UTC' yyyy", "%a %b %-d %H:%M:%S UTC %Y", "", "", 1, 0, ""), ("MM.dd.yyyy", "%m.%d.%Y", "", "", "day", 0, ""),
    ("h:mm a MMMM d yyyy", "%-I:%M %p %B %-d %Y", "", "", 60, 0, ""), ("MMM yyyy", "%b %Y", "", "", "month", 0, ""),
    ("yyyy-MM", "%Y-%m", "", "", "month", 0, ""), ("yyyy", "%Y", "", "", "year", 0, ""),
    ("MMMM d'th' yyyy", "%B %-dth %Y", "", "", "day", 0, ""), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "", ".123", 1, 0, ""),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "  ", ",999", 1, 0, ""), ("HH:mm:ss yyyy-MM-dd", "%H:%M:%S %Y-%m-%d", "", "", 1, 0, ""),
    ("yyyyMMdd HH:mm", "%Y%m%d %H:%M", "", "", 60, 0, ""), ("MMM d yyyy h a", "%b %-d %Y %-I %p", "", "", 3600, 0, ""),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "", " +05:30", 1, 19800, ""), ("yyyy/MM/dd HH:mm:ss", "%Y/%m/%d %H:%M:%S", "", " -0800", 1, -28800, ""),
    ("d MMM yyyy HH:mm", "%-d %b %Y %H:%M", "", " GMT", 60, 0, ""), ("EEE, dd-MMM-yyyy HH:mm:ss", "%a, %d-%b-%Y %H:%M:%S", "", " GMT", 1, 0, ""),
    ("MMMM d 'at' h:mm a, yyyy", "%B %-d at %-I:%M %p, %Y", "", "", 60, 0, ""), ("MM-dd-yyyy HH:mm:ss", "%m-%d-%Y %H:%M:%S", "", "", 1, 0, ""),
    ("yyyy-MMM-dd", "%Y-%b-%d", "", "", "day", 0, ""), ("dd MMM yyyy", "%d %b %Y", "", "", "day", 0, "upper"),
    ("M/d/yyyy, h:mm:ss a", "%-m/%-d/%Y, %-I:%M:%S %p", "", "", 1, 0, ""), ("yyyyMMdd'T'HHmm", "%Y%m%dT%H%M", "", "+01:00", 60, 3600, ""),
    ("dd/MMM/yyyy HH:mm:ss", "%d/%b/%Y %H:%M:%S", "", "", 1, 0, ""), ("EEE d MMM yyyy hh:mm:ss a", "%a %-d %b %Y %I:%M:%S %p", "", " UTC", 1, 0, "upper"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", "x ", "", None, 0, ""), ("yyyy-MM-dd", "%Y-%m-%d", "", " 25:61", None, 0, ""),
)


def _free_form_sql() -> str:
    def case(pick):
        return f"CASE event_id % {len(_FREE_FORMS)} " + " ".join(f"WHEN {i} THEN {pick(*f)}" for i, f in enumerate(_FREE_FORMS)) + " END"

    def written(_, fmt, before, after, kept, east, changed):
        return f"{changed or ""}(concat({S.q(before)}, strftime(ts, {S.q(fmt)}), {S.q(after)}))"

    def read(_, fmt, before, after, kept, east, changed):
        if kept is None:
            return "NULL"
        if isinstance(kept, str):
            return f"epoch(date_trunc('{kept}', ts))"
        return f"floor(epoch(ts)) - floor(epoch(ts)) % {kept} - ({east})"

    return f"SELECT event_id AS row_id, {case(written)} AS ts_raw, CAST({case(read)} AS BIGINT) AS ts_sec FROM events"


@register("timestamp_free_form", _free_form_sql())
def q_timestamp_free_form(spark, sf_dir):
    """TS5: the event times written in some forty ways, two of them no times, read back by the token-class automaton."""
    ev = read_table(spark, sf_dir, "events").selectExpr("event_id AS row_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts")
    raw = F.lit(None).cast("string")
    for i, (fmt, _, before, after, _, _, changed) in enumerate(_FREE_FORMS):
        text = F.concat(F.lit(before), F.date_format("ts", fmt), F.lit(after))
        raw = F.when(F.col("row_id") % len(_FREE_FORMS) == i, {"lower": F.lower, "upper": F.upper, "": lambda x: x}[changed](text)).otherwise(raw)
    return with_ts_seconds(ev.select("row_id", raw.alias("ts_raw")), "ts_raw", "ts_sec", FIXTURE_YEAR)


@register("normalise_ts", f"""WITH {S.LINES_CTE},
{S.parsed_cte()},
n AS (SELECT row_id, ts_raw, {S.ts_seconds_sql('ts_raw', FIXTURE_YEAR)} AS ts_sec FROM parsed)
SELECT row_id, ts_raw, ts_sec, {S.fmt_sec('ts_sec')} AS ts FROM n""")
def q_normalise_ts(spark, sf_dir):
    """TS1-TS8: every route (syslog no-year, apache, ISO, epoch) to UTC seconds."""
    p = with_ts_seconds(parsed_lines(spark, sf_dir), "ts_raw", "ts_sec", FIXTURE_YEAR)
    return p.select("row_id", "ts_raw", "ts_sec", format_seconds("ts_sec").alias("ts"))


@register("url_decode_clean", f"""WITH {S.LINES_CTE},
{S.parsed_cte()}
SELECT row_id, event, {S.url_decode_sql('event')} AS event_decoded,
       {S.clean_sql(S.url_decode_sql('event'))} AS event_clean,
       CAST(length({S.clean_sql(S.url_decode_sql('event'))}) AS BIGINT) AS event_length
FROM parsed""")
def q_url_decode_clean(spark, sf_dir):
    """STR1-STR3 on parsed fixture events."""
    df = CL.add_text_columns(parsed_lines(spark, sf_dir).select("row_id", "event"))
    return df.withColumn("event_length", F.length("event_clean").cast("bigint"))


@register("url_decode_pages", f"""SELECT page_id, {S.url_decode_sql('url')} AS url_decoded,
       {S.clean_sql(S.url_decode_sql('url'))} AS url_clean FROM pages""")
def q_url_decode_pages(spark, sf_dir):
    """STR1/STR2 over every page URL."""
    from logsight.functions.text import clean_text, url_decode_lenient
    from logsight.session import read_table
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return (p.withColumn("url_decoded", url_decode_lenient("url"))
             .withColumn("url_clean", clean_text("url_decoded")).drop("url"))


def _token_sql(src):
    return (f"CAST({S.any_token_sql(src, C.FAIL_WORDS)} AS BIGINT) AS has_fail_tokens, "
            f"CAST({S.any_token_sql(src, C.SQL_TOKENS)} AS BIGINT) AS has_sql_tokens, "
            f"CAST({S.any_token_sql(src, C.PRIV_TOKENS)} AS BIGINT) AS has_priv_tokens, "
            f"CAST({S.any_token_sql(src, C.MALWARE_TOKENS)} AS BIGINT) AS has_malware_tokens")


@register("token_flags", f"""WITH {S.clean_events_cte(FIXTURE_YEAR)}
SELECT row_id, {_token_sql('event_clean')} FROM clean""")
def q_token_flags(spark, sf_dir):
    """STR4: literal token lists over cleaned event text."""
    df = clean_lines(spark, sf_dir, with_features=False)
    t = F.col("event_clean")
    return df.select("row_id",
                     has_any_token(t, C.FAIL_WORDS).cast("bigint").alias("has_fail_tokens"),
                     has_any_token(t, C.SQL_TOKENS).cast("bigint").alias("has_sql_tokens"),
                     has_any_token(t, C.PRIV_TOKENS).cast("bigint").alias("has_priv_tokens"),
                     has_any_token(t, C.MALWARE_TOKENS).cast("bigint").alias("has_malware_tokens"))


@register("doc_ipv4", f"""SELECT doc_id, regexp_extract(text, {S.rx(C.IPV4_RE)}, 0) AS first_ip,
       CAST(len(regexp_extract_all(text, {S.rx(C.IPV4_RE)}, 0)) AS BIGINT) AS n_ips
FROM documents WHERE regexp_matches(text, {S.rx(C.IPV4_RE)})""")
def q_doc_ipv4(spark, sf_dir):
    """LP11 over whole document texts: first IPv4 and number of IPv4s."""
    from logsight.functions.text import first_ipv4
    from logsight.session import read_table
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return (d.withColumn("first_ip", first_ipv4("text")).filter(F.col("first_ip").isNotNull())
             .select("doc_id", "first_ip",
                     F.size(F.regexp_extract_all("text", F.lit(C.IPV4_RE), 0)).cast("bigint").alias("n_ips")))


_CLEAN_COLS = ["row_id", "ts_raw", "ts_sec", "src_ip", "dst_ip", "dst_port", "username", "event",
               "bytes", "duration", "status", "event_clean"]


@register("clean_events", f"""WITH {S.clean_events_cte(FIXTURE_YEAR)}
SELECT {', '.join(_CLEAN_COLS)} FROM clean""")
def q_clean_events(spark, sf_dir):
    """PIPE1 without features: dedupe, normalise, fill, text copies."""
    return clean_lines(spark, sf_dir, with_features=False).select(*_CLEAN_COLS)


@register("cleaning_report", f"""WITH {S.LINES_CTE},
{S.parsed_cte()},
dd AS (SELECT *, row_number() OVER (
         PARTITION BY (ts_raw IS NOT NULL AND event IS NOT NULL), ts_raw, src_ip, event,
           CASE WHEN NOT (ts_raw IS NOT NULL AND event IS NOT NULL)
                THEN struct_pack(a := dst_ip, b := dst_port, c := username, d := bytes, e := duration,
                                 f := status) END ORDER BY row_id) AS _rn FROM parsed),
n AS (SELECT *, {S.ts_seconds_sql('ts_raw', FIXTURE_YEAR)} AS ts_sec FROM dd)
SELECT count(*) AS rows_in, count(*) FILTER (WHERE _rn > 1) AS duplicates_removed,
  count(*) FILTER (WHERE _rn = 1 AND src_ip IS NULL) AS filled_src_ip,
  count(*) FILTER (WHERE _rn = 1 AND username IS NULL) AS filled_username,
  count(*) FILTER (WHERE _rn = 1 AND dst_port IS NULL) AS filled_dst_port,
  count(*) FILTER (WHERE _rn = 1 AND bytes IS NULL) AS filled_bytes,
  count(*) FILTER (WHERE _rn = 1 AND duration IS NULL) AS filled_duration,
  count(*) FILTER (WHERE _rn = 1 AND {S.strip_sql("coalesce(ts_raw, '')")} <> '' AND ts_sec IS NULL) AS unparsable_timestamps,
  count(*) FILTER (WHERE _rn = 1 AND ts_sec IS NOT NULL) AS timestamps_normalised,
  count(*) FILTER (WHERE _rn = 1 AND ts_sec IS NULL) AS missing_timestamp,
  count(*) FILTER (WHERE _rn = 1 AND src_ip IS NULL) AS missing_src_ip,
  count(*) FILTER (WHERE _rn = 1 AND dst_port IS NULL) AS missing_dst_port,
  count(*) FILTER (WHERE _rn = 1 AND username IS NULL) AS missing_username,
  count(*) FILTER (WHERE _rn = 1 AND event IS NULL) AS missing_event,
  count(*) FILTER (WHERE _rn = 1 AND bytes IS NULL) AS missing_bytes,
  count(*) FILTER (WHERE _rn = 1 AND duration IS NULL) AS missing_duration,
  count(*) FILTER (WHERE _rn = 1) AS rows_out
FROM n""")
def q_cleaning_report(spark, sf_dir):
    """AGG12 in one aggregate."""
    return CL.cleaning_report(canonical_lines(spark, sf_dir), assume_year=FIXTURE_YEAR)


@register("ip_profile", f"""WITH {S.features_cte(FIXTURE_YEAR)}
SELECT src_ip, ip_event_count, ip_unique_ports, ip_unique_users, round(ip_fail_ratio, 6) AS ip_fail_ratio
FROM ipstat""")
def q_ip_profile(spark, sf_dir):
    """AGG13: one groupBy(src_ip) for all four statistics."""
    prof = FE.ip_profile(clean_lines(spark, sf_dir, with_features=False))
    return prof.withColumn("ip_fail_ratio", F.round("ip_fail_ratio", 6))


@register("ip_rate", f"""WITH {S.features_cte(FIXTURE_YEAR)}
SELECT row_id, src_ip, ts_sec, CAST(ip_rate_1min AS BIGINT) AS ip_rate_1min FROM rated""")
def q_ip_rate(spark, sf_dir):
    """WIN1: ±30 s same-IP count per row (bucketed RANGE window, joined back)."""
    df = clean_lines(spark, sf_dir)
    return df.select("row_id", "src_ip", "ts_sec", "ip_rate_1min")


_FEAT = ["row_id", "src_ip"] + FE.FEATURE_COLUMNS


@register("features", f"""WITH {S.features_cte(FIXTURE_YEAR)}
SELECT row_id, src_ip, ip_event_count, CAST(ip_rate_1min AS BIGINT) AS ip_rate_1min, ip_unique_ports,
       round(ip_fail_ratio, 6) AS ip_fail_ratio, ip_unique_users, event_length, has_sql_tokens,
       has_priv_tokens, has_malware_tokens FROM feat""")
def q_features(spark, sf_dir):
    """PIPE1 with every behavioural feature attached to each row (JN1)."""
    df = clean_lines(spark, sf_dir).select(*_FEAT)
    return df.withColumn("ip_fail_ratio", F.round("ip_fail_ratio", 6))
