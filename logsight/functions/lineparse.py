"""Raw log line -> canonical fields, as pure Column expressions.

Precedence per trimmed line: apache, then syslog, then ISO application log,
else the generic fallback. Each line is classified once into ``format``;
field extraction is guarded by that class so a line only pays for the
patterns of its own format.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.functions.text import (first_ipv4, first_match, let, nonblank, regexp_groups, remove_first_occurrence,
                                     strip_ws)

KV = dict(C.KV_PATTERNS)


def _mentions(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _kv(text: Column, field: str) -> Column:
    """key=value field, the regex run only when one of its keys occurs."""
    return F.when(_mentions(text, C.KV_KEYWORDS[field]), first_match(text, KV[field]))


def _kv_user(text: Column) -> Column:
    return F.when(_mentions(text, C.KV_KEYWORDS["username"]), first_match(text, "(?U)" + C.KV_USER_RE))


def line_format(s: Column) -> Column:
    """apache / syslog / iso / generic. Each pattern runs only when the line
    has what the pattern needs literally ('[' and '"'; a leading month name;
    a leading digit), so most lines cost one regex."""
    months = C.MONTHS.split("|")
    maybe_apache = s.contains("[") & s.contains('"')
    maybe_syslog = F.substring(s, 1, 3).isin(*months)
    maybe_iso = F.substring(s, 1, 1).between("0", "9")
    return (F.when(maybe_apache & s.rlike(C.APACHE_RE), "apache")
            .when(maybe_syslog & s.rlike(C.SYSLOG_RE), "syslog")
            .when(maybe_iso & s.rlike(C.ISO_RE), "iso")
            .otherwise("generic"))


PARSED_FIELDS = ["format", "ts_raw", "src_ip", "dst_ip", "dst_port", "username", "event", "bytes",
                 "duration", "status", "host", "prog", "parse_ok"]


def _parse_struct(s: Column) -> Column:
    """All fields of one trimmed, non-blank line as a struct.

    Intermediate values (format, the capture groups of the line's format,
    the message body, the raw timestamp) are bound once each with ``let``:
    a filter the optimizer pushes onto any output field then carries this
    one expression, not a copy of every intermediate per reference."""
    def by_format(fmt, apache, syslog, iso, generic):
        return (F.when(fmt == "apache", apache).when(fmt == "syslog", syslog)
                 .when(fmt == "iso", iso).otherwise(generic))

    def with_format(fmt):
        # one regex run per format yields all of its groups
        groups = by_format(fmt, regexp_groups(s, C.APACHE_RE, 6), regexp_groups(s, C.SYSLOG_RE, 4),
                           regexp_groups(s, C.ISO_RE, 3), F.array())
        return let(groups, lambda g: with_groups(fmt, g))

    def with_groups(fmt, g):
        # generic timestamp patterns in order; each guarded by a literal it needs
        guards = (s.contains("-") & s.contains(":"), s.contains(":"), s.contains("/"), F.lit(True))
        gen_ts = F.coalesce(*[F.when(c, F.regexp_substr(s, F.lit(p))) for c, p in zip(guards, C.GENERIC_TS_RES)])
        ts_raw = by_format(fmt, g[2], g[0], g[0], gen_ts)
        # text the key=value rules read: syslog message / ISO rest / whole line
        body = by_format(fmt, F.lit(None).cast("string"), g[3], g[2], s)
        return let(F.struct(ts_raw.alias("t"), body.alias("b")),
                   lambda tb: fields(fmt, g, tb["t"], tb["b"]))

    def fields(fmt, g, ts_raw, body):
        is_ap, is_sy = fmt == "apache", fmt == "syslog"
        req = g[3]
        url = regexp_groups(s, "^.*?" + C.URL_RE, 2)  # leftmost quoted "METHOD url ..."
        ap_event = F.when(url[0] != s, F.concat(url[0], F.lit(" "), url[1])).otherwise(req)
        for_user = first_match(body, "(?U)" + C.SYSLOG_FOR_USER_RE)
        sy_user = F.coalesce(_kv_user(body),
                             F.when(~F.lower(for_user).isin(*C.SYSLOG_FOR_USER_EXCLUDED), for_user))
        # "invalid user" names the user or nobody
        sy_user = F.when(F.lower(body).contains("invalid user"),
                         first_match(body, "(?U)" + C.INVALID_USER_RE)).otherwise(sy_user)
        gen_cut = strip_ws(remove_first_occurrence(s, ts_raw))
        gen_event = F.when(ts_raw.isNull() | (gen_cut == ""), s).otherwise(gen_cut)
        ip_body = first_ipv4(body)
        kv_src = _kv(body, "src_ip")
        src_ip = by_format(fmt, g[0], F.coalesce(kv_src, ip_body), F.coalesce(kv_src, ip_body),
                           F.coalesce(ip_body, kv_src))
        event = by_format(fmt, ap_event, F.concat(g[2], F.lit(": "), g[3]), g[2], gen_event)
        return F.struct(
            fmt.alias("format"), ts_raw.alias("ts_raw"), src_ip.alias("src_ip"),
            _kv(body, "dst_ip").alias("dst_ip"),
            by_format(fmt, first_match(req, C.APACHE_PORT_RE),
                      F.coalesce(_kv(body, "dst_port"), first_match(body, C.SYSLOG_PORT_RE)),
                      _kv(body, "dst_port"), _kv(body, "dst_port")).try_cast("double").alias("dst_port"),
            by_format(fmt, F.when(g[1] != "-", g[1]), sy_user, _kv_user(body),
                      F.coalesce(_kv_user(body), first_match(s, "(?U)" + C.GENERIC_USER_RE))).alias("username"),
            event.alias("event"),
            F.when(is_ap, F.when(g[5].rlike(r"^[0-9]+$"), g[5]))
             .otherwise(_kv(body, "bytes")).try_cast("double").alias("bytes"),
            _kv(body, "duration").try_cast("double").alias("duration"),
            F.when(is_ap, g[4]).otherwise(_kv(body, "status")).alias("status"),
            F.when(is_sy, g[1]).alias("host"),
            F.when(is_sy, g[2]).alias("prog"),
            (event.isNotNull() & (ts_raw.isNotNull() | src_ip.isNotNull())).alias("parse_ok"))

    return let(line_format(s), with_format)


def parse_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Add parsed fields to a DataFrame of log lines.

    Blank lines are dropped. Output keeps the input columns and adds
    ``format, ts_raw, src_ip, dst_ip, dst_port, username, event, bytes,
    duration, status, host, prog, parse_ok``. Row-local: no shuffle, no
    Python; the whole parse is one expression per line.
    """
    keep = list(df.columns)
    parsed = nonblank(df, col, "_s").withColumn("_p", let(F.col("_s"), _parse_struct))
    return parsed.select(*keep, *[F.col("_p")[f].alias(f) for f in PARSED_FIELDS])


def to_canonical_events(parsed: DataFrame, row_id: str = "row_id", label: str | None = None) -> DataFrame:
    """Project parsed lines to the canonical event schema (+ format/host/prog); ``label``, if given, is a column of labels."""
    return parsed.select(
        F.col(row_id).cast("bigint").alias("row_id"), "ts_raw", "src_ip", "dst_ip", "dst_port",
        "username", "event", "bytes", "duration", "status",
        (F.col(label) if label else F.lit(None)).cast("string").alias("label_original"), "format", "host", "prog")
