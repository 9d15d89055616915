"""Legacy operators: exact distributed median, keyword parser, features."""
import random
import statistics

from pyspark.sql import functions as F

from logsight.operators import legacy as LG
from logsight.sources.fixtures import log_lines

SMOKE = "/root/testdata/sf0.001"


def test_exact_median(spark):
    rnd = random.Random(3)
    for vals in ([rnd.random() * 1e6 for _ in range(3001)], [float(rnd.randint(0, 50)) for _ in range(4000)],
                 [5.0] * 2000 + [1.0] * 3 + [9.0] * 1500):
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double")
        assert LG.exact_median(df, "v") == statistics.median(vals)
    assert LG.exact_median(spark.createDataFrame([(None,)], "v double"), "v") is None


def test_fill_generic(spark):
    df = spark.createDataFrame([(1, None, None), (2, 4.0, "a"), (3, 10.0, None), (4, 6.0, "b")],
                               "line_number long, x double, t string")
    out = {r["line_number"]: r for r in LG.fill_missing_generic(df).collect()}
    assert out[1]["x"] == 6.0 and out[1]["t"] == "unknown"
    assert LG.fill_missing_generic(df, "drop").count() == 2


def test_fill_generic_keeps_ids_and_types(spark):
    big = 2 ** 53 + 1
    df = spark.createDataFrame([(big, 1, 3), (big + 1, None, None), (big + 2, 3, 4)], "row_id long, n int, m long")
    out = LG.fill_missing_generic(df)
    rows = {r["row_id"]: r for r in out.collect()}
    assert set(rows) == {big, big + 1, big + 2} and out.schema["row_id"].dataType.simpleString() == "bigint"
    assert rows[big + 1]["n"] == 2 and out.schema["n"].dataType.simpleString() == "int"
    assert rows[big + 1]["m"] == 3.5  # no whole median


def test_preprocessing_stats_count_removed_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "t string, n int")
    done = LG.fill_missing_generic(LG.remove_duplicates(df, ["t", "n"], "n"))
    st = LG.preprocessing_stats(df, done).first()
    assert (st["original_rows"], st["processed_rows"], st["duplicates_removed"]) == (3, 2, 1)


def test_keyword_parser_and_features(spark):
    kw = LG.parse_lines_keywords(log_lines(spark, SMOKE))
    r = kw.filter("event_keywords IS NOT NULL").first()
    assert r["event_keywords"] == ", ".join(sorted(set(r["event_keywords"].split(", "))))
    feats = LG.extract_features(kw)
    row = feats.first()
    assert set(row.asDict()) == {"line_number", "hour", "day_of_week", "is_weekend", "ip_first_octet",
                                 "ip_second_octet", "attack_keyword_count", "has_attack_keywords", "line_length"}
    assert feats.filter("ip_first_octet <> 10").count() == kw.filter("source_ip IS NULL").count() > 0


def test_full_row_duplicates_are_grouped_without_a_sort(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 1), (None, None, 2), (None, None, 2), ("a", "b", 1)],
                               "t string, u string, line_number long")
    out = LG.remove_duplicates(df, list(df.columns))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", None, 1), (None, None, 2), ("a", "b", 1)], key=str)
    assert "SortAggregate" not in out._jdf.queryExecution().toString()


def test_keyword_parser_runs_each_pattern_once(spark):
    df = spark.createDataFrame([(1, "  "), (2, None), (3, " Port scan from 10.0.0.1 and 10.0.0.2, port 5 "), (4, "x")],
                               "row_id long, value string")
    made = df.withColumn("value", F.concat(F.col("value"), F.lit("")))
    kw = LG.parse_lines_keywords(made)
    plan = kw._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and plan.count("concat(") == 1
    rows = {r["line_number"]: r for r in kw.collect()}
    assert set(rows) == {3, 4}
    assert (rows[3]["raw_line"], rows[3]["ip_addresses"], rows[3]["event_keywords"]) == (
        "Port scan from 10.0.0.1 and 10.0.0.2, port 5", "10.0.0.1, 10.0.0.2", "Port, port, scan")
    assert rows[4]["ip_addresses"] is None and rows[4]["event_keywords"] is None


def test_legacy_times_are_tried_by_need_and_made_once(spark):
    from logsight import constants as C
    from logsight.functions.timestamps import ISO_DIRECT_RE, _iso_seconds, legacy_normalise_timestamp
    texts = [a + b + c for a in ("2026-08-14", "2026-8-4", "12026-08-14", "+12026-08-14", "-2026-08-14", "0000-01-01", "14/Aug/2026", "1/Aug/2026", "14/aug/2026", "Aug 14", "aug 4",
                                 "SEP 04", "Aug  4", "Aug -4", "August 14", "ſep 01", "Feb 29", "")
             for b in ("T", "t", " ", ":", "  ", "")
             for c in ("10:22:31", "10:22:31.5", "10:22:31.123456", "10:22:31.123456789", "10:22:31,5", "10:22:31Z", "10:22:31z", "10:22:31+02:00", "10:22:31+0200", "10:22:31.123456+0200",
                       "10:22:31.12Z", "10:22:31 +0200", "10:22:31 Z", "10:22", "25:00:00", "")]
    texts += [" 2026-08-14 10:22:31\t", "x", "T.-/ ", "1900 Aug 14 10:22:31", "12345", None]

    def unguarded(t):
        tries = []
        for f in C.LEGACY_TS_FORMATS:
            text, fmt = (F.concat(F.lit("1900 "), t, F.lit(" +0000")), "yyyy MMM d HH:mm:ss Z") if f == "MMM dd HH:mm:ss" else (t, f) if f.endswith(("Z", "XX")) else (F.concat(t, F.lit(" +0000")), f + " Z")
            tries.append(F.unix_seconds(F.try_to_timestamp(text, F.lit(fmt))))
        return F.coalesce(*tries, F.when(t.rlike(ISO_DIRECT_RE), _iso_seconds(t)))

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", legacy_normalise_timestamp("t").alias("got"), unguarded(F.trim(F.col("t"), F.lit(" \t\n\r\x0b\x0c"))).alias("want")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows] and len({r.got for r in rows}) > 15
    feats = LG.extract_features(spark.createDataFrame([(1, "a", "b", "c", "d")], "line_number long, timestamp string, event_keywords string, source_ip string, raw_line string"))
    assert feats._jdf.queryExecution().optimizedPlan().toString().lower().count("gettimestamp(") <= len(C.LEGACY_TS_FORMATS)


def test_event_words_by_first_letter():
    import re

    from logsight import constants as C
    r, words = random.Random(5), re.findall("[a-z]{3,}", C.LEGACY_EVENT_RE)
    assert LG._EVENT_RE != C.LEGACY_EVENT_RE
    for _ in range(3000):
        text = "".join(r.choice([w, w.upper(), w[:-1], w[1:], " ", "d", "e"]) for w in r.choices(words, k=6))
        assert re.findall(LG._EVENT_RE, text) == re.findall(C.LEGACY_EVENT_RE, text)
    assert LG._by_first_letter("(?i)(?:do|dos)") == "(?i)(?:do|dos)"
