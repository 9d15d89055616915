"""Catalogue: confidence floor, severity, statistics, detections, mitigations,
evaluation tables — all over the deterministic scored fixture."""
from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.operators import detections as DT
from logsight.operators import severity as SV
from logsight.operators import stats as ST
from logsight.operators.evaluation import classification_report, confusion_matrix
from logsight.operators.search import build_index
from logsight.plans import sql_blocks as S
from logsight.plans.catalog import register
from logsight.sources.fixtures import scored_events
from logsight.session import ensure_checkpoint_dir
from logsight.sources.mitigations import DEFAULT_MITIGATIONS, attach_mitigations, load_mitigations

ALL_CATEGORIES = sorted([C.NORMAL_LABEL] + C.ATTACK_CATEGORIES)


def scored(spark, sf_dir, ts: str | None = None):
    """Scored fixture after the confidence floor and the severity rule."""
    sc = scored_events(spark, sf_dir).withColumn("predicted_category", F.col("raw_category"))
    if ts == "day":
        sc = sc.withColumn("ts_sec", F.col("event_sec"))
    elif ts == "minute":
        sc = sc.withColumn("ts_sec", F.lit(1786320000) + F.floor((F.col("ts_sec") - 1786320000) / 3))
    return SV.assign_severity(SV.apply_confidence_floor(sc))


# ---- SQL twin of the scored pipeline ---------------------------------------
def _base_rank_sql(col):
    whens = " ".join(f"WHEN {S.q(k)} THEN {C.SEVERITY_LEVELS.index(v)}" for k, v in C.BASE_SEVERITY.items())
    return f"CASE {col} {whens} ELSE 0 END"


def _level_name_sql(col):
    whens = " ".join(f"WHEN {i} THEN {S.q(n)}" for i, n in enumerate(C.SEVERITY_LEVELS))
    return f"CASE {col} {whens} END"


def _rank_sql(col):
    whens = " ".join(f"WHEN {S.q(n)} THEN {i}" for i, n in enumerate(C.SEVERITY_LEVELS))
    return f"CASE {col} {whens} ELSE -1 END"


def scored_sql(ts: str | None = None) -> str:
    ts_expr = {"day": "event_sec", "minute": "1786320000 + CAST(floor((ts_sec - 1786320000) / 3) AS BIGINT)"}.get(
        ts, "ts_sec")
    return f"""{S.SCORED_CTE},
fl AS (SELECT row_id, {ts_expr} AS ts_sec, src_ip, username, dst_port, raw_category, event,
              round(confidence, 4) AS confidence,
              (raw_category <> 'Normal' AND round(confidence, 4) < {C.CONFIDENCE_ANOMALY_THRESHOLD}) AS low_confidence
       FROM sc),
fl2 AS (SELECT *, CASE WHEN low_confidence THEN 'Normal' ELSE raw_category END AS predicted_category,
               (raw_category <> 'Normal' AND NOT low_confidence) AS is_anomaly FROM fl),
ipa AS (SELECT src_ip, count(*) AS n FROM fl2 WHERE predicted_category <> 'Normal' GROUP BY src_ip),
up AS (SELECT f.*, (f.confidence >= {C.HIGH_CONFIDENCE_NOTE} OR (f.predicted_category <> 'Normal'
                    AND coalesce(a.n, 0) >= {C.SEVERITY_REPEAT_IP_THRESHOLD})) AS _up
       FROM fl2 f LEFT JOIN ipa a USING (src_ip)),
scored AS (SELECT *, CASE WHEN predicted_category <> 'Normal' THEN {_level_name_sql(
        f"greatest(0, least(3, {_base_rank_sql('predicted_category')} + CAST(_up AS INTEGER) - "
        f"CAST(confidence < {C.LOW_CONFIDENCE_NOTE} AND NOT _up AS INTEGER)))")} END AS severity
       FROM up)"""


SCORED = scored_sql()


@register("confidence_floor", f"""WITH {SCORED}
SELECT row_id, predicted_category, confidence, low_confidence, is_anomaly FROM scored""")
def q_confidence_floor(spark, sf_dir):
    """PRJ9 on the scored fixture."""
    return scored(spark, sf_dir).select("row_id", "predicted_category", "confidence", "low_confidence", "is_anomaly")


@register("severity", f"""WITH {SCORED}
SELECT row_id, src_ip, predicted_category, confidence, severity FROM scored""")
def q_severity(spark, sf_dir):
    """SEV1: base level, repeat-attacker and confidence adjustments."""
    return scored(spark, sf_dir).select("row_id", "src_ip", "predicted_category", "confidence", "severity")


@register("severity_legacy", f"""WITH {S.SCORED_CTE}
SELECT row_id, raw_category AS category, CASE raw_category {' '.join(
    f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in C.LEGACY_SEVERITY.items())} ELSE '{C.LEGACY_SEVERITY_DEFAULT}' END
    AS severity FROM sc""")
def q_severity_legacy(spark, sf_dir):
    """SEV2L: static category -> level table."""
    sc = scored_events(spark, sf_dir)
    return sc.select("row_id", F.col("raw_category").alias("category"),
                     SV.legacy_severity("raw_category").alias("severity"))


def _pct_sql(part, whole):
    return f"CASE WHEN {whole} > 0 THEN CAST(floor(({part} * 2000 + {whole}) / ({whole} * 2)) AS BIGINT) / 10.0 ELSE 0.0 END"


@register("totals", f"""WITH {SCORED},
t AS (SELECT count(*) AS total_records, count(*) FILTER (WHERE predicted_category <> 'Normal') AS total_attacks,
             count(*) FILTER (WHERE low_confidence) AS low_confidence_count FROM scored)
SELECT total_records, total_attacks, low_confidence_count, total_records - total_attacks AS total_normal,
       {_pct_sql('total_attacks', 'total_records')} AS attack_pct FROM t""")
def q_totals(spark, sf_dir):
    """AGG1."""
    return ST.totals(scored(spark, sf_dir))


@register("category_breakdown", f"""WITH {SCORED},
c AS (SELECT predicted_category, count(*) AS count FROM scored WHERE predicted_category <> 'Normal'
      GROUP BY predicted_category)
SELECT predicted_category, count, {_pct_sql('count', 'sum(count) OVER ()')} AS share FROM c""")
def q_category_breakdown(spark, sf_dir):
    """AGG2."""
    return ST.category_breakdown(scored(spark, sf_dir))


@register("severity_breakdown", f"""WITH {SCORED},
lv AS (SELECT * FROM (VALUES {', '.join(f"({i}, {S.q(n)})" for i, n in enumerate(C.SEVERITY_LEVELS))})
       AS t(severity_rank, severity)),
c AS (SELECT severity, count(*) AS count FROM scored WHERE predicted_category <> 'Normal' GROUP BY severity)
SELECT lv.severity, lv.severity_rank, coalesce(c.count, 0) AS count FROM lv LEFT JOIN c USING (severity)""")
def q_severity_breakdown(spark, sf_dir):
    """AGG3: all four levels present."""
    return ST.severity_breakdown(scored(spark, sf_dir))


@register("top_ips", f"""WITH {SCORED},
a AS (SELECT * FROM scored WHERE predicted_category <> 'Normal'),
pc AS (SELECT src_ip, predicted_category, count(*) AS n FROM a GROUP BY ALL),
dom AS (SELECT src_ip, predicted_category AS dominant FROM (SELECT *, row_number() OVER (
          PARTITION BY src_ip ORDER BY n DESC, predicted_category) AS rn FROM pc) WHERE rn = 1),
ip AS (SELECT src_ip, count(*) AS attacks, max({_rank_sql('severity')}) AS mr FROM a GROUP BY src_ip)
SELECT ip.src_ip, attacks, dominant, {_level_name_sql('mr')} AS max_severity
FROM ip JOIN dom USING (src_ip) ORDER BY attacks DESC, mr DESC, src_ip LIMIT {C.TOP_K}""")
def q_top_ips(spark, sf_dir):
    """AGG4: top attacker IPs with dominant category and max severity."""
    return ST.top_attacker_ips(scored(spark, sf_dir))


@register("top_users", f"""WITH {SCORED}
SELECT username, count(*) AS count FROM scored WHERE predicted_category <> 'Normal' AND username <> ''
GROUP BY username ORDER BY count DESC, username LIMIT {C.TOP_K}""")
def q_top_users(spark, sf_dir):
    """AGG5."""
    return ST.top_targeted_users(scored(spark, sf_dir))


@register("top_ports", f"""WITH {SCORED}
SELECT CAST(dst_port AS INTEGER) AS port, count(*) AS count FROM scored
WHERE predicted_category <> 'Normal' AND dst_port IS NOT NULL AND dst_port < {C.SERVICE_PORT_LIMIT}
GROUP BY port ORDER BY count DESC, port LIMIT {C.TOP_K}""")
def q_top_ports(spark, sf_dir):
    """AGG6 + FLT3."""
    return ST.top_targeted_ports(scored(spark, sf_dir))


def _timeline_sql(ts):
    return f"""WITH {scored_sql(ts)},
sp AS (SELECT max(ts_sec) - min(ts_sec) AS span, count(ts_sec) AS n FROM scored),
u AS (SELECT CASE WHEN span / 60 <= 60 THEN 60 WHEN span / 3600 <= 60 THEN 3600 ELSE 86400 END AS secs,
             CASE WHEN span / 60 <= 60 THEN 'minute' WHEN span / 3600 <= 60 THEN 'hour' ELSE 'day' END AS unit
      FROM sp WHERE n >= 5 AND span > 0),
b AS (SELECT ts_sec - (ts_sec % secs) AS bucket, unit FROM scored, u
      WHERE predicted_category <> 'Normal' AND ts_sec IS NOT NULL)
SELECT CASE WHEN unit = 'day' THEN {S.fmt_sec('bucket', '%Y-%m-%d')} ELSE {S.fmt_sec('bucket', '%Y-%m-%d %H:%M')} END
       AS time, unit, count(*) AS count FROM b GROUP BY bucket, unit"""


@register("timeline", _timeline_sql(None))
def q_timeline(spark, sf_dir):
    """WIN2 (span 8,639 s -> hour buckets)."""
    return ST.attack_timeline(scored(spark, sf_dir))


def _reason_sql(source):
    codes = [S.q(c) for c, _ in ST.TIMELINE_REASONS]
    words = [S.q(w) for _, w in ST.TIMELINE_REASONS]
    case = "CASE WHEN a = 0 THEN {} WHEN n < 5 THEN {} WHEN span <= 0 THEN {} WHEN ta = 0 THEN {} END"
    return f"""SELECT {case.format(*codes)} AS code, {case.format(*words)} AS reason FROM (
  SELECT count(*) FILTER (WHERE predicted_category <> 'Normal') AS a, count(ts_sec) AS n, max(ts_sec) - min(ts_sec) AS span,
         count(*) FILTER (WHERE predicted_category <> 'Normal' AND ts_sec IS NOT NULL) AS ta FROM ({source}))"""


_REASON_CASES = {
    "as_read": ("predicted_category", "ts_sec"), "no_attacks": ("'Normal'", "ts_sec"),
    "few_timestamps": ("predicted_category", "CASE WHEN row_id < 4 THEN ts_sec END"),
    "one_instant": ("predicted_category", "CAST(7 AS BIGINT)"),
    "attacks_without_time": ("predicted_category", "CASE WHEN predicted_category = 'Normal' THEN ts_sec END"),
}


@register("timeline_reason", f"WITH {SCORED}\n" + "\nUNION ALL ".join(
    f"SELECT '{name}' AS kind, code, reason FROM (" + _reason_sql(
        f"SELECT {cat} AS predicted_category, {ts} AS ts_sec FROM scored") + ")"
    for name, (cat, ts) in _REASON_CASES.items()))
def q_timeline_reason(spark, sf_dir):
    """AGG7: why a timeline is empty, for the scored rows and four reductions of them."""
    sc = scored(spark, sf_dir)
    out = None
    for name, (cat, ts) in _REASON_CASES.items():
        one = ST.timeline_reason(sc.selectExpr(f"{cat} AS predicted_category", f"{ts} AS ts_sec"))
        one = one.select(F.lit(name).alias("kind"), "code", "reason")
        out = one if out is None else out.unionByName(one)
    return out


@register("timeline_day", _timeline_sql("day"))
def q_timeline_day(spark, sf_dir):
    """WIN2 over the raw 30-day event times -> day buckets."""
    return ST.attack_timeline(scored(spark, sf_dir, "day"))


@register("timeline_minute", _timeline_sql("minute"))
def q_timeline_minute(spark, sf_dir):
    """WIN2 over times compressed 3x (span < 1 h) -> minute buckets."""
    return ST.attack_timeline(scored(spark, sf_dir, "minute"))


@register("top_detections", f"""WITH {SCORED}
SELECT row_id, {S.fmt_sec('ts_sec')} AS timestamp, src_ip, username, predicted_category, severity, confidence,
       event
FROM scored WHERE predicted_category <> 'Normal'
ORDER BY {_rank_sql('severity')} DESC, confidence DESC, row_id LIMIT {C.TOP_DETECTIONS}""")
def q_top_detections(spark, sf_dir):
    """SRT2."""
    return ST.top_detections(scored(spark, sf_dir))


@register("worst_finding", f"""WITH {SCORED},
t AS (SELECT row_id, {S.fmt_sec('ts_sec')} AS timestamp, src_ip, username, predicted_category, severity,
             confidence, event
      FROM scored WHERE predicted_category <> 'Normal'
      ORDER BY {_rank_sql('severity')} DESC, confidence DESC, row_id LIMIT 1),
c AS (SELECT predicted_category AS top_category, count(*) AS top_category_count FROM scored
      WHERE predicted_category <> 'Normal' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT * FROM t LEFT JOIN c ON true""")
def q_worst_finding(spark, sf_dir):
    """SRT6."""
    return ST.worst_finding(scored(spark, sf_dir))


# ---- detections API ---------------------------------------------------------
_DET_FILTER = dict(category="Brute Force", severity="High", query="User1")


@register("detections_filter", f"""WITH {SCORED}
SELECT row_id, src_ip, username, predicted_category, severity, confidence FROM scored
WHERE is_anomaly AND predicted_category = 'Brute Force' AND severity = 'High'
  AND contains(lower(concat(coalesce(event, ''), ' ', coalesce(src_ip, ''), ' ', coalesce(username, ''))), 'user1')""")
def q_detections_filter(spark, sf_dir):
    """FLT1: category, severity and literal case-insensitive search."""
    return (DT.filter_detections(scored(spark, sf_dir), **_DET_FILTER)
            .select("row_id", "src_ip", "username", "predicted_category", "severity", "confidence"))


_NEEDLES = ("failed password", "User1", "10.0.", "/etc/passwd", "a", "no such text anywhere")


@register("detections_search", f"""WITH {SCORED},
w AS (SELECT unnest([{", ".join(S.q(n) for n in _NEEDLES)}]) AS needle)
SELECT needle, row_id, predicted_category FROM scored, w WHERE is_anomaly
  AND contains(lower(concat(coalesce(event, ''), ' ', coalesce(src_ip, ''), ' ', coalesce(username, ''))), lower(needle))""")
def q_detections_search(spark, sf_dir):
    """FLT1 by a gram index over all detections: frequent, rare, short and absent needles."""
    index = build_index(DT.filter_detections(scored(spark, sf_dir)))
    found = [index.search(n).select(F.lit(n).alias("needle"), "row_id", "predicted_category") for n in _NEEDLES]
    return functools.reduce(DataFrame.unionByName, found)


def _page_sql(order, page_no):
    return f"""WITH {SCORED},
d AS (SELECT *, row_number() OVER (ORDER BY {order}, row_id) AS pos, count(*) OVER () AS total
      FROM scored WHERE is_anomaly),
p AS (SELECT least({page_no}, greatest(1, CAST(ceil(max(total) / {C.PAGE_SIZE}) AS BIGINT))) AS page,
             greatest(1, CAST(ceil(max(total) / {C.PAGE_SIZE}) AS BIGINT)) AS last_page FROM d)
SELECT pos, row_id, {S.fmt_sec('ts_sec')} AS timestamp, src_ip, coalesce(username, '') AS username,
       predicted_category AS category, severity, round(confidence, 3) AS confidence, event,
       total, page, last_page
FROM d, p WHERE pos > (page - 1) * {C.PAGE_SIZE} AND pos <= page * {C.PAGE_SIZE}"""


def _page_query(key, ascending, page_no):
    def q(spark, sf_dir):
        det = DT.filter_detections(scored(spark, sf_dir))
        return DT.page(det, key, ascending, page_no)
    q.__doc__ = f"WIN5 + SRT1: detections sorted by {key} ({'asc' if ascending else 'desc'}), page {page_no}."
    return q


_d = "DESC NULLS LAST"
_a = "ASC NULLS LAST"
register("detections_page", _page_sql(f"{_rank_sql('severity')} {_d}, confidence {_d}", 3))(
    _page_query("severity", False, 3))
register("detections_sort_time", _page_sql(f"ts_sec {_a}", 2))(_page_query("time", True, 2))
register("detections_sort_ip", _page_sql(f"src_ip {_d}", 1))(_page_query("src_ip", False, 1))
register("detections_last_page", _page_sql(f"confidence {_a}", 100000))(_page_query("confidence", True, 100000))


# ---- mitigations --------------------------------------------------------------
def _mitigation_values():
    rows = []
    for cat, summary, steps, mitre in DEFAULT_MITIGATIONS:
        rows.append(f"({S.q(cat)}, {S.q(summary)}, {len(steps)}, {S.q(', '.join(mitre))})")
    return ", ".join(rows)


@register("mitigations", f"""WITH {SCORED},
m AS (SELECT * FROM (VALUES {_mitigation_values()}) AS t(category, summary, n_steps, mitre)),
c AS (SELECT predicted_category AS category, count(*) AS attacks FROM scored WHERE is_anomaly GROUP BY 1)
SELECT c.category, c.attacks, coalesce(m.summary, '') AS summary, CAST(coalesce(m.n_steps, 0) AS INTEGER) AS n_steps,
       coalesce(m.mitre, '') AS mitre
FROM c LEFT JOIN m USING (category) WHERE c.category IN ({', '.join(map(S.q, C.ATTACK_CATEGORIES))})""")
def q_mitigations(spark, sf_dir):
    """JN3 + FLT5 + SRC8: the dictionary read from JSON; advice for every detected attack category."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logsight-stage/mitigations-{uuid.uuid4().hex}"
    text = json.dumps({c: {"summary": s, "steps": steps, "mitre": ids} for c, s, steps, ids in DEFAULT_MITIGATIONS})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    counts = (scored(spark, sf_dir).filter("is_anomaly").groupBy("predicted_category")
              .agg(F.count(F.lit(1)).alias("attacks")))
    out = attach_mitigations(SV.known_categories(counts, "predicted_category"), load_mitigations(spark, path))
    return out.select(F.col("predicted_category").alias("category"), "attacks", "summary",
                      F.size("steps").alias("n_steps"), F.concat_ws(", ", "mitre").alias("mitre"))


# ---- evaluation ------------------------------------------------------------------
_CM_COLS = ", ".join(f"count(*) FILTER (WHERE predicted_category = {S.q(c)}) AS \"{c}\"" for c in ALL_CATEGORIES)


@register("confusion_matrix", f"""WITH {SCORED}
SELECT raw_category AS label, {_CM_COLS} FROM scored GROUP BY raw_category""")
def q_confusion_matrix(spark, sf_dir):
    """AGG16: truth (pre-floor category) x prediction (post-floor)."""
    return confusion_matrix(scored(spark, sf_dir), "raw_category", "predicted_category", ALL_CATEGORIES)


@register("classification_report", f"""WITH {SCORED},
pairs AS (SELECT raw_category AS label, predicted_category AS pred, count(*) AS n FROM scored GROUP BY 1, 2),
cls AS (SELECT label AS class FROM pairs UNION SELECT pred FROM pairs),
m AS (SELECT class,
        coalesce((SELECT sum(n) FROM pairs WHERE label = class AND pred = class), 0) AS tp,
        coalesce((SELECT sum(n) FROM pairs WHERE pred = class), 0) AS predicted,
        coalesce((SELECT sum(n) FROM pairs WHERE label = class), 0) AS support FROM cls),
r AS (SELECT class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, CAST(support AS BIGINT) AS support FROM m)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1,
       support FROM r""")
def q_classification_report(spark, sf_dir):
    """AGG15: per-class precision / recall / F1 / support."""
    return classification_report(scored(spark, sf_dir), "raw_category", "predicted_category")
