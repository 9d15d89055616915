"""Sources: lenient CSV, column mapping, log files, workbooks, admission."""
import io
import os
import zipfile

from logsight.operators.columns import map_columns, to_canonical
from logsight.sources.admission import check_files
from logsight.sources.delimited import read_delimited
from logsight.sources.logs import read_log_lines
from logsight.sources.workbooks import read_workbooks, workbook_frame


def _write(path, data, mode="w", encoding="utf-8"):
    with open(path, mode, **({} if "b" in mode else {"encoding": encoding})) as fh:
        fh.write(data)
    return path


def test_map_columns_aliases():
    m = map_columns(["Source Address", "Datetime", "Log Message", "Total Bytes", "Attack Type"])
    assert m == {"timestamp": "Datetime", "src_ip": "Source Address", "event": "Log Message",
                 "bytes": "Total Bytes", "label_original": "Attack Type"}
    # 'client' alone is not an alias for src_ip (only 'client ip' / 'clientip')
    assert "src_ip" not in map_columns(["client", "message"])


def test_semicolon_latin1_blank_short_long(spark, tmpdir_path):
    text = ("time;ip;msg;bytes\n2026-08-14 10:00:00;10.0.0.1;caf\xe9 ok;512KB\n\n"
            "2026-08-14 10:00:01;10.0.0.2\n2026-08-14 10:00:02;10.0.0.3;too;many;fields\n"
            "2026-08-14 10:00:03;10.0.0.4;1,234 done;1,024\n")
    p = _write(os.path.join(tmpdir_path, "broken.csv"), text, encoding="latin-1")
    raw, meta = read_delimited(spark, p, dense_ids=True)
    assert meta["separator"] == ";" and meta["encoding"] == "ISO-8859-1"
    canon, m = to_canonical(raw)
    rows = {r["row_id"]: r for r in canon.collect()}
    assert sorted(rows) == [1, 2, 3]          # blank skipped, over-long row dropped
    assert rows[1]["event"] == "café ok" and rows[1]["bytes"] == 512.0
    assert rows[2]["event"] is None and rows[2]["src_ip"] == "10.0.0.2"   # short row padded
    assert rows[3]["bytes"] == 1024.0


def test_event_synthesised_and_extras(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "t.csv"), "src_ip,proto,note,count\n1.1.1.1,tcp, hello  world ,3\n"
                                                   "2.2.2.2,,,4\n")
    raw, _ = read_delimited(spark, p, dense_ids=True)
    canon, meta = to_canonical(raw)
    rows = sorted(canon.collect(), key=lambda r: r["row_id"])
    assert rows[0]["event"] == "tcp | hello world" and rows[0]["extra_count"] == 3.0
    assert rows[1]["event"] is None
    assert meta["column_mapping"]["event"] == "proto + note"


def test_log_lines_file_order_and_latin1(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "logs")
    os.makedirs(d)
    _write(os.path.join(d, "a.log"), "first\n\n  \nsecond\nthird\n")
    _write(os.path.join(d, "b.log"), "caf\xe9 fourth\n", encoding="latin-1")
    rows = read_log_lines(spark, d, dense_ids=True).orderBy("row_id").collect()
    assert [r["value"] for r in rows] == ["first", "second", "third", "café fourth"]
    assert [r["row_id"] for r in rows] == [1, 2, 3, 4]


def _xlsx(sheets, macro=False):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("[Content_Types].xml", "<Types/>")
        wb = "".join(f'<sheet name="{n}" sheetId="{i+1}" r:id="rId{i+1}"/>' for i, (n, _) in enumerate(sheets))
        zf.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
                    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                    f"<sheets>{wb}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i+1}" Target="worksheets/sheet{i+1}.xml"/>' for i in range(len(sheets)))
        zf.writestr("xl/_rels/workbook.xml.rels",
                    f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}'
                    "</Relationships>")
        for i, (_, rows) in enumerate(sheets):
            body = ""
            for r, vals in enumerate(rows, start=1):
                cells = "".join(f'<c r="{chr(65 + j)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
                                for j, v in enumerate(vals))
                body += f'<row r="{r}">{cells}</row>'
            zf.writestr(f"xl/worksheets/sheet{i+1}.xml",
                        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                        f"<sheetData>{body}</sheetData></worksheet>")
        if macro:
            zf.writestr("xl/vbaProject.bin", b"\x00")
    return buf.getvalue()


def test_workbook_first_nonempty_sheet(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "wb")
    os.makedirs(d)
    _write(os.path.join(d, "flows.xlsx"), _xlsx([("empty", []), ("flows", [["src_addr", "msg", "flow_bytes"],
                                                                            ["1.2.3.4", "hello", "10"],
                                                                            ["5.6.7.8", "bye", "20"]])]), "wb")
    rows = read_workbooks(spark, d)
    assert rows.select("sheet").distinct().first()[0] == "flows"
    canon, _ = to_canonical(workbook_frame(rows).drop("file_path", "sheet"))
    got = sorted((r["src_ip"], r["event"], r["bytes"]) for r in canon.collect())
    assert got == [("1.2.3.4", "hello", 10.0), ("5.6.7.8", "bye", 20.0)]


def test_admission(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "adm")
    os.makedirs(d)
    _write(os.path.join(d, "ok.csv"), "a,b\n1,2\n")
    _write(os.path.join(d, "bin.log"), b"abc\x00def", "wb")
    _write(os.path.join(d, "empty.log"), "")
    _write(os.path.join(d, "report.pdf"), "%PDF")
    _write(os.path.join(d, "macro.xlsx"), _xlsx([("s", [["a"], ["1"]])], macro=True), "wb")
    _write(os.path.join(d, "good.xlsx"), _xlsx([("s", [["a"], ["1"]])]), "wb")
    _write(os.path.join(d, "fake.xlsx"), "not a zip")
    v = {os.path.basename(r["path"]): (r["admitted"], r["reason"]) for r in check_files(spark, d).collect()}
    assert v["ok.csv"] == (True, "")
    assert v["good.xlsx"] == (True, "")
    assert v["bin.log"][0] is False and "text" in v["bin.log"][1]
    assert v["empty.log"] == (False, "empty file")
    assert v["report.pdf"] == (False, "extension not allowed")
    assert v["macro.xlsx"] == (False, "contains macros")
    assert v["fake.xlsx"] == (False, "not a zip archive")


def test_read_events_dispatch_and_row_cap(spark, tmpdir_path):
    from logsight.sources.dispatch import read_events
    log = _write(os.path.join(tmpdir_path, "auth.log"),
                 "Aug 14 10:22:31 h sshd[1]: Failed password for root from 10.0.0.1 port 22 ssh2\n"
                 "Aug 14 10:22:32 h sshd[1]: Failed password for root from 10.0.0.1 port 22 ssh2\n"
                 "Aug 14 10:22:33 h sshd[1]: Accepted password for bob from 10.0.0.2 port 22 ssh2\n")
    csvp = _write(os.path.join(tmpdir_path, "t.csv"), "timestamp,source ip,message\n2026-08-14 10:00:00,1.1.1.1,hi\n")
    ev, meta = read_events(spark, [log, csvp])
    got = sorted((r["detected_type"], r["src_ip"]) for r in ev.collect())
    assert got == [("delimited text", "1.1.1.1"), ("log lines", "10.0.0.1"),
                   ("log lines", "10.0.0.1"), ("log lines", "10.0.0.2")]
    assert meta[".csv"]["column_mapping"]["src_ip"] == "source ip"
    capped = read_log_lines(spark, log, max_rows_per_file=2).orderBy("row_id").collect()
    assert [r["row_id"] for r in capped] == [1, 2] and "Accepted" not in capped[-1]["value"]


def test_mitigations_json_and_training_frame(spark, tmpdir_path):
    import json
    from logsight.sources.dispatch import training_frame
    from logsight.sources.mitigations import attach_mitigations, load_mitigations
    p = _write(os.path.join(tmpdir_path, "m.json"), json.dumps(
        {"Port Scan": {"summary": "s", "steps": ["a", "b"], "mitre": ["T1046"]}}))
    table = load_mitigations(spark, p)
    df = spark.createDataFrame([("Port Scan",), ("Other",)], "predicted_category string")
    rows = {r["predicted_category"]: r for r in attach_mitigations(df, table).collect()}
    assert rows["Port Scan"]["steps"] == ["a", "b"] and rows["Other"]["steps"] == [] and rows["Other"]["summary"] == ""
    tf = training_frame(spark.createDataFrame([(1, "x", "Normal")], "row_id long, event string, label string"))
    assert "label_original" in tf.columns and tf.schema["dst_port"].dataType.simpleString() == "double"


def test_read_table_plain(spark, tmpdir_path):
    from logsight.sources.delimited import read_table_plain
    p = _write(os.path.join(tmpdir_path, "plain.csv"), "a,b\n1,x\n2,y\n")
    df = read_table_plain(spark, p)
    assert df.schema["a"].dataType.simpleString() == "int" and df.count() == 2


def test_latin1_log_larger_than_a_split_keeps_every_line(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "big.log")
    with open(p, "wb") as fh:
        for k in range(118_300):
            fh.write(b"caf\xe9 line %d " % k + b"x" * 170 + b"\n")
    assert os.path.getsize(p) > 20 * 1024 * 1024
    lines = read_log_lines(spark, p)
    assert lines.count() == 118_300
    assert lines.filter("value like 'café line %'").count() == 118_300
    assert lines.select("row_id").distinct().count() == 118_300


def test_latin1_byte_late_in_a_csv(spark, tmpdir_path):
    body = "".join(f"{k},plain text number {k}\n" for k in range(6000)).encode() + b"6000,caf\xe9\n"
    p = _write(os.path.join(tmpdir_path, "late.csv"), b"id,message\n" + body, "wb")
    raw, meta = read_delimited(spark, p)
    assert meta["encoding"] == "ISO-8859-1" and raw.count() == 6001
    assert raw.filter("id = '6000'").first()["message"] == "café"


def test_quotes_and_line_breaks(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "q.csv"), 'time,message\n1,"he said ""a"", then b"\n2,"two\nlines"\n3,plain\n')
    rows = {r["time"]: r["message"] for r in read_delimited(spark, p)[0].collect()}
    assert rows == {"1": 'he said "a", then b', "2": "two\nlines", "3": "plain"}


def test_each_csv_has_its_own_layout(spark, tmpdir_path):
    from logsight.sources.dispatch import read_events
    a = _write(os.path.join(tmpdir_path, "a.csv"), "source ip,message,count\n1.1.1.1,first,7\nN/A,null,8\n")
    b = _write(os.path.join(tmpdir_path, "b.csv"), "message;Src Addr\nsecond;2.2.2.2\n")
    c = _write(os.path.join(tmpdir_path, "c file.csv"), "client_ip,msg\n3.3.3.3,caf\xe9\n", encoding="latin-1")
    d = _write(os.path.join(tmpdir_path, "auth.log"), "Aug 14 10:22:31 h sshd[1]: Failed password for root from 10.0.0.1 port 22 ssh2\n")
    wb = os.path.join(tmpdir_path, "wanted.xlsx")
    _write(wb, _xlsx([("s", [["src_addr", "msg"], ["4.4.4.4", "x"], ["5.5.5.5", "y"]])]), "wb")
    _write(os.path.join(tmpdir_path, "other.xlsx"), _xlsx([("s", [["src_addr", "msg"], ["9.9.9.9", "no"]])]), "wb")
    for dense in (False, True):
        ev, _ = read_events(spark, [a, b, c, d, wb], dense_ids=dense)
        rows = ev.collect()
        got = sorted((r["src_ip"] or "", r["event"] or "") for r in rows if r["detected_type"] != "log lines")
        assert got == [("", ""), ("1.1.1.1", "first"), ("2.2.2.2", "second"), ("3.3.3.3", "café"), ("4.4.4.4", "x"), ("5.5.5.5", "y")]
        ids = sorted(r["row_id"] for r in rows)
        assert len(set(ids)) == len(rows) == 7 and (not dense or ids == list(range(1, 8)))
        assert sorted(r["extra_count"] for r in rows if r["extra_count"] is not None) == [7.0, 8.0]


def test_more_than_twenty_numeric_columns_stay(spark, tmpdir_path):
    names = [f"n{k}" for k in range(30)]
    p = _write(os.path.join(tmpdir_path, "w.csv"), ",".join(["message", *names]) + "\nhi," + ",".join(["1"] * 29 + ["N/A"]) + "\n")
    canon, _ = to_canonical(read_delimited(spark, p)[0])
    assert [c for c in canon.columns if c.startswith("extra_")] == [f"extra_{n}" for n in names]


def test_workbook_errors_are_not_silent(spark, tmpdir_path):
    import pytest
    p = _write(os.path.join(tmpdir_path, "bad.xlsx"), b"no zip", "wb")
    with pytest.raises(Exception, match="bad.xlsx"):
        read_workbooks(spark, p).count()


def test_training_rows_are_numbered(spark):
    from logsight.sources.dispatch import training_frame
    df = spark.createDataFrame([(f"e{k}", "Normal") for k in range(50)], "event string, label string").repartition(7)
    assert sorted(r["row_id"] for r in training_frame(df).collect()) == list(range(1, 51))


def test_plain_table_by_suffix(spark, tmpdir_path):
    from logsight.sources.delimited import read_table_plain
    spark.range(3).write.parquet(os.path.join(tmpdir_path, "t.parquet"))
    assert read_table_plain(spark, os.path.join(tmpdir_path, "t.parquet")).count() == 3
    p = _write(os.path.join(tmpdir_path, "t.csv"), 'a,b\n1,"x ""y"""\n')
    assert [tuple(r) for r in read_table_plain(spark, p).collect()] == [(1, 'x "y"')]


def test_large_text_files_are_judged_in_splits(spark, tmpdir_path):
    files = {"plain.csv": b"a,b\n1,2\n" * 900, "late nul.log": b"x y z\n" * 900 + b"\0", "n%20ä+b c.csv": b"\0" * 4000, "mark.csv": b"\xef\xbb\xbfa,b\n" * 2 + b"1,2\n" * 900,
             "onlymark.csv": b"\xef\xbb\xbf", "mark2.csv": b"\xef\xbb\xbf" + b"a" * 4 + b"\n", "odd.csv": b"\x01\xe9\n" * 900, "cr.log": b"a\rb\r\n" * 900, "blank.csv": b" \r\n\0\n" * 900}
    for name, data in files.items():
        with open(f"{tmpdir_path}/{name}", "wb") as f:
            f.write(data)
    for mode in ("strict", "readable"):
        judged = lambda **k: {r.path: (r.length, r.ext, r.admitted, r.reason) for r in check_files(spark, tmpdir_path, mode=mode, max_bytes=None, **k).collect()}
        want = judged(head_bytes=1 << 20)  # each file as one value
        assert len(want) == len(files) and len({v[3] for v in want.values()}) == 2
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
        spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
        try:
            assert judged() == want
        finally:
            spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
