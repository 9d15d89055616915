"""Cleaning: duplicates, fill, text copies."""
from pyspark.sql import functions as F

from logsight.functions.text import clean_text, url_decode_lenient
from logsight.operators import clean as CL

SCHEMA = "row_id long, ts_raw string, src_ip string, event string, username string"


def test_three_identical_rows_two_removed(spark):
    rows = [(i, "2026-08-14 10:22:31", "1.2.3.4", "x", None) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = CL.dedupe_events(df).collect()
    assert [r["row_id"] for r in kept] == [1]
    rep = CL.cleaning_report(df, 2026).first()
    assert rep["duplicates_removed"] == 2 and rep["rows_out"] == 1


def test_unkeyed_rows_compare_all_columns(spark):
    rows = [(1, None, "1.2.3.4", "x", "a"), (2, None, "1.2.3.4", "x", "b"), (3, None, "1.2.3.4", "x", "a")]
    kept = sorted(r["row_id"] for r in CL.dedupe_events(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == [1, 2]


def test_fill_missing(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    r = CL.fill_missing(CL.ensure_canonical(df)).first()
    assert r["src_ip"] == "unknown" and r["dst_ip"] == "unknown" and r["username"] == "" and r["event"] == ""
    assert r["dst_port"] is None


def test_url_decode_lenient(spark):
    df = spark.createDataFrame([("a+b%20c",), ("100%",), ("%zz%41",), ("plain",), ("id=1%27%20OR",)], "s string")
    out = [r[0] for r in df.select(url_decode_lenient("s")).collect()]
    assert out == ["a+b c", "100%", "%zzA", "plain", "id=1' OR"]


def test_clean_text(spark):
    df = spark.createDataFrame([("  Hello\t\nWORLD  " + "x" * 600,)], "s string")
    r = df.select(clean_text("s").alias("c")).first()["c"]
    assert r == " hello world " + "x" * 600  # the whole text, unless a limit is asked for
    assert len(df.select(clean_text("s", 500).alias("c")).first()["c"]) == 500


def test_token_after_character_500_counts(spark):
    from logsight.functions.text import has_any_token, url_decode_lenient
    df = spark.createDataFrame([("x" * 2500 + " mimikatz %41",)], "event string")
    r = df.select(has_any_token(clean_text(url_decode_lenient("event")), ["mimikatz a"]).alias("t")).first()
    assert r["t"]


def test_repeated_row_ids_never_multiply(spark):
    from logsight.operators.clean import cleaning_report, flag_duplicates
    rows = [(k % 5, f"t{k // 2}", "1.1.1.1", "e") for k in range(10)]
    df = spark.createDataFrame(rows, "row_id long, ts_raw string, src_ip string, event string")
    assert flag_duplicates(df).count() == 10
    rep = cleaning_report(df).first()
    assert (rep["rows_in"], rep["duplicates_removed"], rep["rows_out"]) == (10, 5, 5)
