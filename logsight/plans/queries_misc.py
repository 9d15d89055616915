"""Catalogue: profiling, duplicates over documents, legacy operators, report
tables, tabular/log sources round trips, admission."""
from __future__ import annotations

from pyspark.sql import functions as F

from logsight import constants as C
from logsight.functions.lineparse import parse_lines, to_canonical_events
from logsight.functions.text import spreadsheet_safe
from logsight.functions.timestamps import format_seconds, legacy_normalise_timestamp
from logsight.operators import clean as CL
from logsight.operators import legacy as LG
from logsight.operators import profile as PF
from logsight.operators import severity as SV
from logsight.operators.columns import to_canonical
from logsight.operators.detections import filter_detections
from logsight.operators.report import report_tables
from logsight.plans import sql_blocks as S
from logsight.plans.catalog import register
from logsight.plans.inputs import canonical_lines
from logsight.plans.queries_stats import SCORED, _pct_sql, _rank_sql, _timeline_sql, scored
from logsight.session import ensure_checkpoint_dir, read_table, spread
from logsight.sources.admission import check_files
from logsight.sources.delimited import read_delimited
from logsight.sources.fixtures import log_lines, scored_events
from logsight.sources.logs import read_log_lines
from logsight.sources.mitigations import (DEFAULT_MITIGATIONS, LEGACY_ADVICE, LEGACY_ADVICE_DEFAULT, attach_advice,
                                          legacy_advice_table)

# ---- profiling ----------------------------------------------------------------
_CANON_SQL = f"""WITH {S.LINES_CTE},
{S.parsed_cte()},
canon AS (SELECT row_id, ts_raw, src_ip, dst_ip, dst_port, username, event, bytes, duration, status,
                 CAST(NULL AS VARCHAR) AS label_original, format, host, prog FROM parsed)"""
_CANON_COLS = ["row_id", "ts_raw", "src_ip", "dst_ip", "dst_port", "username", "event", "bytes", "duration",
               "status", "label_original", "format", "host", "prog"]


@register("missing_profile", _CANON_SQL + "\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing FROM canon" for c in _CANON_COLS)
    + ")")
def q_missing_profile(spark, sf_dir):
    """AGG8 over the parsed canonical fixture (one aggregate, unpivoted)."""
    return PF.missing_counts(canonical_lines(spark, sf_dir))


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"]


@register("numeric_profile", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 2) AS mean, "
    f"round(min(CAST({c} AS DOUBLE)), 2) AS min, round(max(CAST({c} AS DOUBLE)), 2) AS max FROM lineitem"
    for c in _LI_NUM) + ") WHERE count > 0")
def q_numeric_profile(spark, sf_dir):
    """AGG9 over every numeric column of lineitem in one aggregate."""
    return PF.numeric_profile(read_table(spark, sf_dir, "lineitem"))


@register("missing_orders", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing FROM orders"
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]) + ")")
def q_missing_orders(spark, sf_dir):
    """AGG8 over orders."""
    return PF.missing_counts(read_table(spark, sf_dir, "orders"))


_DUP_COLS = [c for c in _CANON_COLS if c != "row_id"]


@register("duplicate_estimate", f"""{_CANON_SQL},
f AS (SELECT count(*) - count(DISTINCT ({', '.join(_DUP_COLS)})) AS full_row_duplicates FROM canon),
k AS (SELECT coalesce(sum(n - 1), 0) AS key_duplicates FROM (SELECT count(*) AS n FROM canon
      WHERE ts_raw IS NOT NULL AND event IS NOT NULL GROUP BY ts_raw, src_ip, event))
SELECT full_row_duplicates, CAST(key_duplicates AS BIGINT) AS key_duplicates,
       CAST(full_row_duplicates + key_duplicates AS BIGINT) AS duplicates_detected FROM f, k""")
def q_duplicate_estimate(spark, sf_dir):
    """AGG10 (row_id excluded from the full-row test)."""
    out = PF.duplicate_estimate(canonical_lines(spark, sf_dir))
    return out.select(F.col("full_row_duplicates").cast("bigint"), F.col("key_duplicates").cast("bigint"),
                      F.col("duplicates_detected").cast("bigint"))


@register("column_profile", _CANON_SQL + "\nSELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", "
    f"{S.q(PF.ROLES.get(c, 'number' if c in ('dst_port', 'bytes', 'duration') else 'text'))} AS role, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS missing FROM canon" for i, c in enumerate(_CANON_COLS)) + ")")
def q_column_profile(spark, sf_dir):
    """AGG20 column part: role and missing count per column."""
    return PF.column_profile(canonical_lines(spark, sf_dir))


@register("head_rows", f"""{_CANON_SQL}
SELECT {', '.join(_CANON_COLS)} FROM canon ORDER BY row_id LIMIT 20""")
def q_head_rows(spark, sf_dir):
    """SRT5: first 20 rows in file order."""
    return PF.head(canonical_lines(spark, sf_dir))


# ---- duplicates over whole documents ----------------------------------------------
_DOC_SQL = f"""WITH {S.parsed_cte('documents', 'doc_id', 'text')},
dd AS (SELECT *, row_number() OVER (
         PARTITION BY (ts_raw IS NOT NULL AND event IS NOT NULL), ts_raw, src_ip, event,
           CASE WHEN NOT (ts_raw IS NOT NULL AND event IS NOT NULL)
                THEN struct_pack(a := dst_ip, b := dst_port, c := username, d := bytes, e := duration,
                                 f := status) END ORDER BY row_id) AS _rn FROM parsed)"""


def _doc_events(spark, sf_dir):
    docs = spread(read_table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("row_id"),
                                                                 F.col("text").alias("value"))
    return to_canonical_events(parse_lines(docs))


@register("dedupe_documents", f"""{_DOC_SQL}
SELECT row_id, format, ts_raw, src_ip, CAST(length(event) AS BIGINT) AS event_chars FROM dd WHERE _rn = 1""")
def q_dedupe_documents(spark, sf_dir):
    """DD1 over whole documents read as log records (exact copies collapse)."""
    kept = CL.dedupe_events(_doc_events(spark, sf_dir))
    return kept.select("row_id", "format", "ts_raw", "src_ip", F.length("event").cast("bigint").alias("event_chars"))


@register("flag_duplicates", f"""{_DOC_SQL}
SELECT row_id, _rn > 1 AS is_duplicate FROM dd""")
def q_flag_duplicates(spark, sf_dir):
    """DD2 over whole documents."""
    return CL.flag_duplicates(_doc_events(spark, sf_dir)).select("row_id", "is_duplicate")


# ---- legacy generation -----------------------------------------------------------------
def _legacy_kw_sql():
    ip = S.rx(C.IPV4_RE)
    ev = S.rx(C.LEGACY_EVENT_RE)
    us = S.rx(C.LEGACY_USER_RE)
    return f"""{S.LINES_CTE},
l0 AS (SELECT row_id, {S.strip_sql('value')} AS s FROM lines),
kw AS (SELECT row_id AS line_number, s AS raw_line,
         nullif(regexp_extract(s, {S.rx(C.LEGACY_TS_RE)}, 1), '') AS timestamp,
         CASE WHEN len(regexp_extract_all(s, {ip}, 0)) > 0 THEN array_to_string(regexp_extract_all(s, {ip}, 0), ', ') END
           AS ip_addresses,
         nullif(regexp_extract(s, {ip}, 0), '') AS source_ip,
         coalesce(nullif(regexp_extract(s, {us}, 1), ''), nullif(regexp_extract(s, {us}, 2), '')) AS username,
         CASE WHEN len(regexp_extract_all(s, {ev}, 0)) > 0
              THEN array_to_string(list_sort(list_distinct(regexp_extract_all(s, {ev}, 0))), ', ') END AS event_keywords,
         s AS event_description
       FROM l0 WHERE s <> '')"""


_KW_COLS = ["line_number", "timestamp", "ip_addresses", "source_ip", "username", "event_keywords",
            "event_description"]


def _kw_frame(spark, sf_dir):
    return LG.parse_lines_keywords(log_lines(spark, sf_dir))


@register("legacy_keywords", f"WITH {_legacy_kw_sql()}\nSELECT {', '.join(_KW_COLS)} FROM kw")
def q_legacy_keywords(spark, sf_dir):
    """LP13L: keyword line parser."""
    return _kw_frame(spark, sf_dir).select(*_KW_COLS)


def _legacy_ts_sql(x):
    tz_fmts = ["%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z"]
    plain = ["%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S"]
    parts = [f"epoch(try_strptime({x}, '{f}'))" for f in tz_fmts]
    parts += [f"epoch(try_strptime({x}, '{f}'))" for f in plain]
    parts += [f"epoch(try_strptime({x}, '%d/%b/%Y:%H:%M:%S %z'))",
              f"epoch(try_strptime(concat('1900 ', {x}), '%Y %b %d %H:%M:%S'))"]
    return f"CAST(floor(coalesce({', '.join(parts)})) AS BIGINT)"


@register("legacy_ts", f"""WITH {S.LINES_CTE},
{S.parsed_cte()}
SELECT row_id, ts_raw, {S.fmt_sec(_legacy_ts_sql(S.strip_sql('ts_raw')))} AS normalized_timestamp FROM parsed""")
def q_legacy_ts(spark, sf_dir):
    """TS9L: eight explicit formats in order (no-year text -> 1900)."""
    from logsight.plans.inputs import parsed_lines
    p = parsed_lines(spark, sf_dir)
    return p.select("row_id", "ts_raw",
                    format_seconds(legacy_normalise_timestamp("ts_raw")).alias("normalized_timestamp"))


@register("legacy_features", f"""WITH {_legacy_kw_sql()},
t AS (SELECT *, {_legacy_ts_sql(S.strip_sql('timestamp'))} AS sec FROM kw),
k AS (SELECT *, CASE WHEN event_keywords IS NULL THEN 0 ELSE {' + '.join(
    f"CAST(contains(lower(event_keywords), {S.q(w)}) AS INTEGER)" for w in C.LEGACY_ATTACK_KEYWORDS)} END AS n_kw FROM t)
SELECT line_number,
  CAST(coalesce(hour(make_timestamp(sec * 1000000)), 0) AS INTEGER) AS hour,
  CAST(coalesce(isodow(make_timestamp(sec * 1000000)) - 1, 0) AS INTEGER) AS day_of_week,
  CAST(coalesce(isodow(make_timestamp(sec * 1000000)) - 1, 0) >= 5 AS INTEGER) AS is_weekend,
  coalesce(TRY_CAST(split_part(coalesce(source_ip, 'None'), '.', 1) AS INTEGER), 0) AS ip_first_octet,
  coalesce(TRY_CAST(nullif(split_part(coalesce(source_ip, 'None'), '.', 2), '') AS INTEGER), 0) AS ip_second_octet,
  n_kw AS attack_keyword_count, CAST(n_kw > 0 AS INTEGER) AS has_attack_keywords,
  CAST(length(raw_line) AS INTEGER) AS line_length
FROM k""")
def q_legacy_features(spark, sf_dir):
    """PIPE4L: the eight legacy numeric features."""
    return LG.extract_features(_kw_frame(spark, sf_dir))


@register("legacy_dedupe", f"""WITH {_legacy_kw_sql()}
SELECT line_number, source_ip, username FROM (SELECT *, row_number() OVER (
  PARTITION BY source_ip, username ORDER BY line_number) AS rn FROM kw) WHERE rn = 1""")
def q_legacy_dedupe(spark, sf_dir):
    """DD3L: keep the first line per (source_ip, username)."""
    kept = LG.remove_duplicates(_kw_frame(spark, sf_dir), ["source_ip", "username"])
    return kept.select("line_number", "source_ip", "username")


_FILL_NUM = ["dst_port", "bytes", "duration"]
_FILL_TXT = ["ts_raw", "src_ip", "dst_ip", "username", "event", "status", "label_original", "format", "host",
             "prog"]


@register("legacy_fill", f"""{_CANON_SQL},
m AS (SELECT {', '.join(f"coalesce(median({c}), 0.0) AS m_{c}" for c in _FILL_NUM)} FROM canon)
SELECT row_id, {', '.join(f"coalesce({c}, m_{c}) AS {c}" for c in _FILL_NUM)},
       {', '.join(f"coalesce({c}, 'unknown') AS {c}" for c in _FILL_TXT)}
FROM canon, m""")
def q_legacy_fill(spark, sf_dir):
    """PRJ8: text -> 'unknown', numbers -> exact column median."""
    return LG.fill_missing_generic(canonical_lines(spark, sf_dir))


def _legacy_scored(spark, sf_dir):
    sc = scored_events(spark, sf_dir).withColumn("category", F.coalesce("raw_category", F.lit(C.NORMAL_LABEL)))
    return sc.withColumn("severity", SV.legacy_severity("category")).withColumn("is_anomaly", F.lit(True))


_LEG_SEV = "CASE raw_category " + " ".join(
    f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in C.LEGACY_SEVERITY.items()) + f" ELSE '{C.LEGACY_SEVERITY_DEFAULT}' END"
_LEG_SC = f"{S.SCORED_CTE},\nlg AS (SELECT *, raw_category AS category, {_LEG_SEV} AS severity FROM sc)"


@register("legacy_stats", f"""WITH {_LEG_SC},
t AS (SELECT count(*) AS total_records, count(*) FILTER (WHERE category <> 'Normal') AS total_attacks,
             count(*) FILTER (WHERE category = 'Normal') AS normal_records FROM lg)
SELECT *, CASE WHEN total_records > 0 THEN CAST(floor((total_attacks * 20000 + total_records) / (total_records * 2))
          AS BIGINT) / 100.0 ELSE 0.0 END AS attack_percentage FROM t""")
def q_legacy_stats(spark, sf_dir):
    """AGG17L totals (2 dp)."""
    return LG.attack_statistics(_legacy_scored(spark, sf_dir))


@register("legacy_distribution", f"""WITH {_LEG_SC}
SELECT 'category' AS kind, category AS name, count(*) AS count FROM lg WHERE category <> 'Normal' GROUP BY category
UNION ALL
SELECT 'severity', coalesce(severity, 'Medium'), count(*) FROM lg WHERE category <> 'Normal' GROUP BY 2""")
def q_legacy_distribution(spark, sf_dir):
    """AGG17L category and severity distributions."""
    return LG.attack_distribution(_legacy_scored(spark, sf_dir))


@register("legacy_filter", f"""WITH {_LEG_SC}
SELECT row_id, category, severity FROM lg WHERE severity = 'Critical'""")
def q_legacy_filter(spark, sf_dir):
    """FLT1L: 'All' categories, severity Critical."""
    df = _legacy_scored(spark, sf_dir).withColumn("predicted_category", F.col("category"))
    out = filter_detections(df, category="All", severity="Critical", legacy_all=True)
    return out.select("row_id", "category", "severity")


def _advice_values():
    return ", ".join(f"({S.q(c)}, {S.q(t)})" for c, t in LEGACY_ADVICE)


@register("legacy_advice", f"""WITH {_LEG_SC},
a AS (SELECT * FROM (VALUES {_advice_values()}) AS t(category, mitigation))
SELECT lg.category, count(*) AS count, coalesce(a.mitigation, {S.q(LEGACY_ADVICE_DEFAULT)}) AS mitigation
FROM lg LEFT JOIN a USING (category) GROUP BY lg.category, a.mitigation""")
def q_legacy_advice(spark, sf_dir):
    """JN4: one advice sentence per category (broadcast dimension)."""
    counts = _legacy_scored(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    adv = legacy_advice_table(spark)
    return attach_advice(counts, adv)


@register("legacy_timeline", f"""WITH {_LEG_SC}
SELECT row_id, {S.fmt_sec('ts_sec')} AS timestamp, category, severity FROM lg WHERE category <> 'Normal'
ORDER BY timestamp, row_id LIMIT 50""")
def q_legacy_timeline(spark, sf_dir):
    """SRT3L: attacks in timestamp-text order, first 50."""
    df = _legacy_scored(spark, sf_dir).filter(F.col("category") != C.NORMAL_LABEL)
    df = df.withColumn("timestamp", format_seconds("ts_sec"))
    return df.orderBy("timestamp", "row_id").limit(50).select("row_id", "timestamp", "category", "severity")


# ---- report -------------------------------------------------------------------------------
def _safe_sql(x):
    quoted = f"CASE WHEN regexp_matches({x}, '^[=+\\-@]') THEN concat('''', {x}) ELSE {x} END"
    return f"replace(replace(replace({quoted}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@register("spreadsheet_safe", f"SELECT doc_id, {_safe_sql('text')} AS cell FROM documents")
def q_spreadsheet_safe(spark, sf_dir):
    """SNK2 over whole document texts."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", spreadsheet_safe("text").alias("cell"))


@register("spreadsheet_safe_lines", f"""WITH {S.LINES_CTE}
SELECT row_id, {_safe_sql("concat('-', value)")} AS cell FROM lines""")
def q_spreadsheet_safe_lines(spark, sf_dir):
    """SNK2 where every cell needs neutralising (fixture lines behind a '-')."""
    return log_lines(spark, sf_dir).select("row_id", spreadsheet_safe(F.concat(F.lit("-"), "value")).alias("cell"))


def _num_sql(x):
    return f"format('{{:,}}', {x})"


def _summary_sql():
    def num(x):
        return "format('{:,}', " + x + ")"
    return f"""WITH {SCORED},
t AS (SELECT count(*) AS total_records, count(*) FILTER (WHERE predicted_category <> 'Normal') AS total_attacks,
             count(*) FILTER (WHERE low_confidence) AS low_confidence_count FROM scored),
t2 AS (SELECT *, {_pct_sql('total_attacks', 'total_records')} AS attack_pct FROM t),
d AS (SELECT {S.fmt_sec('ts_sec')} AS ts, src_ip, predicted_category, severity FROM scored
      WHERE predicted_category <> 'Normal' ORDER BY {_rank_sql('severity')} DESC, confidence DESC, row_id LIMIT 1),
c AS (SELECT predicted_category AS top_category, count(*) AS top_count FROM scored
      WHERE predicted_category <> 'Normal' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
p AS (SELECT CASE WHEN total_attacks = 0 THEN [
          printf('Analysed %s records from %s; none matched a known attack category.',
                 {num('total_records')}, 'events'),
          'An empty result is not proof of safety: only six attack categories are modelled.']
        ELSE list_filter([
          printf('Analysed %s records from %s: %s (%.1f%%) look like attacks, mostly %s (%d events).',
                 {num('total_records')}, 'events', {num('total_attacks')}, attack_pct, top_category,
                 top_count),
          CASE WHEN d.severity IS NOT NULL THEN concat('Most severe: ', d.severity, ' ', d.predicted_category,
               ' from ', d.src_ip, CASE WHEN d.ts IS NOT NULL THEN concat(' at ', d.ts) ELSE '' END, '.') END,
          CASE WHEN low_confidence_count > 0 THEN printf('%d more events were low-confidence attack calls, '
               || 'counted as normal.', low_confidence_count) END], lambda x: x IS NOT NULL) END AS l
      FROM t2 LEFT JOIN d ON true LEFT JOIN c ON true)
SELECT unnest(generate_series(0, len(l) - 1)) AS ord, unnest(l) AS paragraph FROM p"""


def _report_sql():
    cents = "CAST(floor(confidence * 100 + 0.5) AS BIGINT)"
    conf2 = f"concat(CAST({cents} // 100 AS VARCHAR), '.', lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))"
    advice = ", ".join(
        f"({S.q(c)}, {S.q(text + (' (ATT&CK: ' + ', '.join(ids) + ')' if ids else ''))}, [{', '.join(map(S.q, steps))}])"
        for c, text, steps, ids in DEFAULT_MITIGATIONS)
    figures = (("Records read", _num_sql("total_records")), ("Attack records", _num_sql("total_attacks")),
               ("Normal records", _num_sql("total_normal")), ("Share of attacks", "printf('%.1f%%', attack_pct)"),
               ("Attacks under the confidence floor", _num_sql("low_confidence_count")))
    key = "\nUNION ALL ".join(f"SELECT 'key_figures' AS section, {i} AS ord, {S.q(n)} AS label, {v} AS value FROM t2"
                              for i, (n, v) in enumerate(figures, 1))
    return f"""WITH {SCORED},
t AS (SELECT count(*) AS total_records, count(*) FILTER (WHERE predicted_category <> 'Normal') AS total_attacks,
             count(*) FILTER (WHERE low_confidence) AS low_confidence_count FROM scored),
t2 AS (SELECT *, total_records - total_attacks AS total_normal,
              {_pct_sql('total_attacks', 'total_records')} AS attack_pct FROM t),
c AS (SELECT predicted_category, count(*) AS count FROM scored WHERE predicted_category <> 'Normal' GROUP BY 1),
c2 AS (SELECT *, {_pct_sql('count', 'sum(count) OVER ()')} AS share,
              row_number() OVER (ORDER BY count DESC, predicted_category) AS ord FROM c),
lv AS (SELECT * FROM (VALUES {', '.join(f"({i}, {S.q(n)})" for i, n in enumerate(C.SEVERITY_LEVELS, 1))}) AS v(r, s)),
sv AS (SELECT severity, count(*) AS count FROM scored WHERE predicted_category <> 'Normal' GROUP BY 1),
d AS (SELECT *, row_number() OVER (ORDER BY {_rank_sql('severity')} DESC, confidence DESC, row_id) AS ord
      FROM scored WHERE predicted_category <> 'Normal' QUALIFY ord <= 10),
adv AS (SELECT * FROM (VALUES {advice}) AS v(category, summary, steps)),
st AS (SELECT c2.ord AS co, category, unnest(range(1, len(steps) + 1)) AS i, unnest(steps) AS step
       FROM c2 JOIN adv ON category = predicted_category),
tl AS ({_timeline_sql(None)}),
says AS ({_summary_sql().replace("'events'", "'the input'")})
{key}
UNION ALL SELECT 'no_attacks', 1, '', 'No category, severity or mitigation to report.' FROM t2 WHERE total_attacks = 0
UNION ALL SELECT 'categories', ord, {_safe_sql('predicted_category')}, printf('%d (%.1f%%)', count, share) FROM c2
UNION ALL SELECT 'severity', lv.r, lv.s, CAST(coalesce(sv.count, 0) AS VARCHAR)
          FROM lv LEFT JOIN sv ON sv.severity = lv.s, t2 WHERE total_attacks > 0
UNION ALL SELECT 'timeline', row_number() OVER (ORDER BY time), time, CAST(count AS VARCHAR) FROM tl
UNION ALL SELECT 'top_detections', ord, CAST(row_id AS VARCHAR), concat_ws(' | ', coalesce({S.fmt_sec('ts_sec')}, '-'),
    {_safe_sql('src_ip')}, {_safe_sql('predicted_category')}, severity, {conf2}, {_safe_sql('event')}) FROM d
UNION ALL SELECT 'mitigations', ord, predicted_category, summary FROM c2 JOIN adv ON category = predicted_category
UNION ALL SELECT 'steps', row_number() OVER (ORDER BY co, i), category, step FROM st
UNION ALL SELECT 'sentences', ord + 1, '', paragraph FROM says"""


@register("report_tables", _report_sql())
def q_report_tables(spark, sf_dir):
    """SNK5: ordered incident-report tables as one long table."""
    from logsight.session import stage
    return report_tables(stage(scored(spark, sf_dir), "scored"))


# ---- sources: tabular and log round trips through the shared stage folder ----------------
_CSV_HEADER = ["Datetime", "Source Address", "Destination Port", "Account", "Log Message", "Total Bytes",
               "Flow Duration", "Status Code", "Attack Type", "Protocol", "Value"]


def _csv_source_sql():
    return f"""{S.LINES_CTE},
src AS (SELECT l.row_id, e.ts, e.value AS v, c.ip, c.port, c.usr, m.msg, l.label, e.event_type
        FROM lines l JOIN lines_c c USING (row_id) JOIN lines_m m USING (row_id) JOIN events e ON e.event_id = l.row_id)"""


@register("csv_roundtrip", f"""WITH {_csv_source_sql()}
SELECT row_number() OVER (ORDER BY row_id) AS row_id,
  strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts_raw, ip AS src_ip, CAST(NULL AS VARCHAR) AS dst_ip,
  CASE WHEN row_id % 11 = 0 THEN NULL ELSE CAST(port AS DOUBLE) END AS dst_port,
  CASE WHEN row_id % 7 = 0 THEN NULL ELSE usr END AS username, msg AS event,
  CAST(port * 3 AS DOUBLE) AS bytes, CAST(port * 10 AS DOUBLE) AS duration,
  CASE WHEN event_type = 'error' THEN '403' ELSE '200' END AS status, label AS label_original,
  v AS extra_Value
FROM src""")
def q_csv_roundtrip(spark, sf_dir):
    """SRC1 + PRJ1-PRJ5: a ';'-separated file with alias headers, written to the
    shared stage folder from ``events``, read back leniently and mapped to the
    canonical schema (unit suffixes, thousands separators, an extra numeric
    column, an unmapped text column)."""
    lines = log_lines(spark, sf_dir).select("row_id", "label")
    ev = read_table(spark, sf_dir, "events")
    src = ev.join(lines, ev["event_id"] == lines["row_id"]).selectExpr(
        "row_id", "date_format(CAST(ts AS TIMESTAMP_NTZ), 'yyyy-MM-dd HH:mm:ss') AS `Datetime`",
        "concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(10 + user_id % 12 AS STRING)) AS `Source Address`",
        "CASE WHEN row_id % 11 = 0 THEN NULL ELSE CAST(20 + (event_id * 37) % 60000 AS STRING) END AS `Destination Port`",
        "CASE WHEN row_id % 7 = 0 THEN '' ELSE concat('user', CAST(user_id % 20 AS STRING)) END AS `Account`",
        "CAST(NULL AS STRING) AS `Log Message`",
        "concat(CAST((20 + (event_id * 37) % 60000) * 3 AS STRING), 'KB') AS `Total Bytes`",
        "format_number((20 + (event_id * 37) % 60000) * 10, 0) AS `Flow Duration`",
        "CASE WHEN event_type = 'error' THEN '403' ELSE '200' END AS `Status Code`",
        "label AS `Attack Type`", "CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS `Protocol`",
        "CAST(value AS STRING) AS `Value`", "event_type", "user_id", "event_id")
    # the message is the fixture's log message text
    msgs = _fixture_messages(spark, sf_dir)
    src = src.drop("Log Message").join(msgs, "row_id").select("row_id", *[F.col(f"`{h}`") for h in _CSV_HEADER])
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logsight-stage/csv-{_uid()}"
    src.orderBy("row_id").drop("row_id").write.option("header", True).option("sep", ";").csv(path)
    raw, _ = read_delimited(spark, path, dense_ids=True)
    canon, _ = to_canonical(raw)
    return canon


@register("synthesised_events", """SELECT p_partkey AS row_id, CAST(NULL AS VARCHAR) AS src_ip,
  nullif(regexp_replace(regexp_replace(concat_ws(' | ', p_name, p_brand, p_type), '\\s+', ' ', 'g'), '^[ |]+|[ |]+$', '', 'g'), '') AS event,
  CAST(p_partkey AS DOUBLE) AS extra_p_partkey, CAST(p_size AS DOUBLE) AS extra_p_size, p_retailprice AS extra_p_retailprice
FROM part""")
def q_synthesised_events(spark, sf_dir):
    """PRJ2 + PRJ3: a table without an event column, its text columns joined into one and its numbers kept."""
    part = read_table(spark, sf_dir, "part")
    raw = part.select(F.col("p_partkey").alias("row_id"), *[F.col(c).cast("string") for c in part.columns])
    canon, _ = to_canonical(raw)
    return canon.select("row_id", "src_ip", "event", "extra_p_partkey", "extra_p_size", "extra_p_retailprice")


def _fixture_messages(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.selectExpr(
        "event_id AS row_id",
        """CASE event_type
        WHEN 'error'    THEN concat('Failed password for ', concat('user', CAST(user_id % 20 AS STRING)), ' from ',
             concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(10 + user_id % 12 AS STRING)), ' port ',
             CAST(20 + (event_id * 37) % 60000 AS STRING), ' ssh2')
        WHEN 'signup'   THEN concat('Invalid user ', concat('user', CAST(user_id % 20 AS STRING)), ' from ',
             concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(10 + user_id % 12 AS STRING)), ' port ',
             CAST(20 + (event_id * 37) % 60000 AS STRING))
        WHEN 'purchase' THEN concat('query id=1%27%20OR%201=1-- src=',
             concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(10 + user_id % 12 AS STRING)),
             ' user=', concat('user', CAST(user_id % 20 AS STRING)))
        WHEN 'click'    THEN concat('sudo COMMAND=/bin/sh user=', concat('user', CAST(user_id % 20 AS STRING)),
             ' src=', concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(10 + user_id % 12 AS STRING)),
             ' bytes=', CAST(20 + (event_id * 37) % 60000 AS STRING))
        ELSE concat('Accepted password for ', concat('user', CAST(user_id % 20 AS STRING)), ' from ',
             concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(10 + user_id % 12 AS STRING)), ' port 22 ssh2')
        END AS `Log Message`""")


def _uid():
    import uuid
    return uuid.uuid4().hex


_PARSE_OUT = ["row_id", "format", "ts_raw", "src_ip", "dst_ip", "dst_port", "username", "event", "bytes",
              "duration", "status", "host", "prog"]


@register("log_roundtrip", f"""WITH {S.LINES_CTE},
{S.parsed_cte()}
SELECT row_number() OVER (ORDER BY row_id) AS row_id, {', '.join(_PARSE_OUT[1:])} FROM parsed""")
def q_log_roundtrip(spark, sf_dir):
    """SRC3 + LP*: fixture lines written as text files to the shared stage
    folder, read back in parallel (dense file-order ids) and parsed."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logsight-stage/log-{_uid()}"
    log_lines(spark, sf_dir).orderBy("row_id").select("value").write.text(path)
    lines = read_log_lines(spark, path, dense_ids=True)
    return to_canonical_events(parse_lines(lines)).select(*_PARSE_OUT)


@register("file_check", """SELECT 'events' AS folder, '.csv' AS ext, true AS admitted, '' AS reason, 4 AS files, count(*) AS rows FROM events
UNION ALL SELECT 'documents', '.csv', false, 'does not look like text', 2, count(*) FROM documents""")
def q_file_check(spark, sf_dir):
    """SRC5: ``events`` written as four CSV files, and ``documents`` as two with NUL bytes, then admitted or not."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logsight-stage/check-{_uid()}"
    nul = F.concat(F.lit("a\u0000b"), F.col("text"))
    tables = {"events": (read_table(spark, sf_dir, "events").drop("props"), 4),
              "documents": (read_table(spark, sf_dir, "documents").select("doc_id", nul.alias("text")), 2)}
    out = None
    for name, (df, files) in tables.items():
        simple = df.select(*[F.col(c).cast("string") for c in df.columns])
        simple.repartition(files).write.option("header", True).csv(f"{base}/{name}")
        one = check_files(spark, f"{base}/{name}", max_bytes=None).filter("ext = '.csv'")
        one = one.groupBy("ext", "admitted", "reason").agg(F.count(F.lit(1)).cast("int").alias("files"))
        # one row each
        one = one.withColumn("folder", F.lit(name)).crossJoin(df.agg(F.count(F.lit(1)).alias("rows")))
        out = one if out is None else out.unionByName(one)
    return out


# ---- legacy preprocessing, preview, summary ---------------------------------------------
_LEGACY_NOW = "2026-01-01 00:00:00"  # fill value for missing timestamps (a parameter, not the clock)
_KW_TEXT = ["raw_line", "timestamp", "ip_addresses", "source_ip", "username", "event_keywords", "event_description"]


def _legacy_pre(spark, sf_dir):
    return LG.preprocess_data(_kw_frame(spark, sf_dir), _LEGACY_NOW)


@register("legacy_preprocess", f"""WITH {_legacy_kw_sql()},
t AS (SELECT *, {_legacy_ts_sql(S.strip_sql('timestamp'))} AS sec FROM kw)
SELECT line_number, {', '.join(f"coalesce({c}, 'unknown') AS {c}" for c in _KW_TEXT)},
       coalesce({S.fmt_sec('sec')}, '{_LEGACY_NOW}') AS normalized_timestamp FROM t""")
def q_legacy_preprocess(spark, sf_dir):
    """PIPE1L: full-row dedupe -> legacy timestamps -> generic fill."""
    out = _legacy_pre(spark, sf_dir)
    return out.select("line_number", *_KW_TEXT,
                      F.date_format("normalized_timestamp", "yyyy-MM-dd HH:mm:ss").alias("normalized_timestamp"))


@register("legacy_preprocessing_stats", f"""WITH {_legacy_kw_sql()}
SELECT count(*) AS original_rows, count(*) AS processed_rows, CAST(0 AS BIGINT) AS duplicates_removed,
       {len(_KW_TEXT) + 2} AS n_columns FROM kw""")
def q_legacy_preprocessing_stats(spark, sf_dir):
    """AGG18L: rows before/after the legacy preprocessing (a log frame carries
    line numbers, so full-row dedupe removes nothing)."""
    st = LG.preprocessing_stats(_kw_frame(spark, sf_dir), _legacy_pre(spark, sf_dir))
    return st.select("original_rows", "processed_rows", "duplicates_removed",
                     F.size("columns").alias("n_columns"))


_KW_TYPES = [("line_number", "bigint"), ("raw_line", "string"), ("timestamp", "string"),
             ("ip_addresses", "string"), ("source_ip", "string"), ("username", "string"),
             ("event_keywords", "string"), ("event_description", "string")]


@register("dataset_preview", f"""WITH {_legacy_kw_sql()}
SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS missing "
    f"FROM kw" for i, (c, t) in enumerate(_KW_TYPES)) + ")")
def q_dataset_preview(spark, sf_dir):
    """AGG19L: columns, types and null counts of the legacy keyword frame."""
    return PF.dataset_preview(_kw_frame(spark, sf_dir), order_col="line_number")["columns"]


@register("summary_sentences", _summary_sql())
def q_summary_sentences(spark, sf_dir):
    """STR8: plain-language summary paragraphs from the scored fixture, one row each."""
    from logsight.operators.report import summary_sentences
    out = summary_sentences(scored(spark, sf_dir), "events")
    return out.select(F.posexplode("paragraphs").alias("ord", "paragraph")).select(
        F.col("ord").cast("bigint"), "paragraph")
