"""Quoted records cut split by split, against a character machine over the whole file."""
import csv
import io
import os
import random

import pytest

from logsight.sources.delimited import read_delimited
from logsight.sources.records import _loose_fields, read_records


def ends_inside(record, sep):
    """Whether a record, read from its start, ends in a quoted field."""
    at = "start"
    for c in record:
        if at == "quoted":
            at = "quote" if c == '"' else at
        elif at == "quote" and c == '"':
            at = "quoted"
        elif c in (sep, "\r"):
            at = "start"
        elif at == "start" and c == '"':
            at = "quoted"
        else:
            at = "plain"
    return at == "quoted"


def plain_records(text, sep):
    lines, out, k = text.removesuffix("\n").split("\n"), [], 0
    while k < len(lines):
        end = k
        while ends_inside("\n".join(lines[k:end + 1]), sep) and end + 1 < len(lines):
            end += 1
        record = "\n".join(lines[k:end + 1])
        if ends_inside(record, sep):  # nothing closes it
            return out + [f for x in lines[k:] if x.strip(" \t\r\n") for f in _loose_fields(x, sep)]
        if record.strip(" \t\r\n"):
            out += list(csv.reader(io.StringIO(record.removesuffix("\r"), newline=""), delimiter=sep))
        k = end + 1
    return out


@pytest.fixture()
def small_splits(spark):
    keep = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "40"}
    for k, v in keep.items():
        spark.conf.set(k, v)
    yield
    for k in keep:
        spark.conf.unset(k)


@pytest.mark.parametrize("seed", range(3))
def test_random_files_in_many_splits(spark, tmpdir_path, small_splits, seed):
    r = random.Random(seed)
    sep, texts = r.choice(",;"), {}
    for k in range(6):
        pieces = ["a", "b", sep, '"', "\n", '""', '"x"', sep + '"', '"\n', '"' + sep, "é", "\r\n", *(["\r"] if k == 0 else [])]
        texts[f"f{k}.csv"] = f"h1{sep}h2\n" + "".join(r.choices(pieces, k=r.randint(5, 500))) + r.choice(["", "\n"])
    # a record over many splits, and a quote that nothing closes
    texts["long.csv"] = f'h1{sep}h2\n1{sep}"' + "line\n" * 300 + f'"\n2{sep}b\n'
    texts["open.csv"] = f'h1{sep}h2\n1{sep}"x\ny"\n2{sep}"b\n' + f"c{sep}d\n" * 100
    for name, text in texts.items():
        with open(os.path.join(tmpdir_path, name), "w", newline="", encoding="utf-8") as f:
            f.write(text)
    df = read_records(spark, [os.path.join(tmpdir_path, f) for f in texts], sep)
    got = {}
    for row in df.orderBy("_file", "_split", "_mono", "nth").collect():
        got.setdefault(os.path.basename(row._file), []).append(list(row.fields))
    for name, text in texts.items():
        assert got.get(name, []) == plain_records(text, sep)[1:], name
    assert df.filter("_file LIKE '%open.csv'").select("_split").distinct().count() > 3


def test_reader_uses_every_split_of_a_file(spark, tmpdir_path, small_splits):
    path = os.path.join(tmpdir_path, "q.csv")
    rows = [(str(k), f'say ""{k}""\nand, again' if k % 3 else "plain", "x" * (k % 7)) for k in range(200)]
    with open(path, "w", newline="") as f:
        f.write("id,message,rest\r\n" + "".join(f'{a},"{b}",{c}\r\n' for a, b, c in rows) + '900,"a\nb",c,d\n\n901,"\n"\n')
    raw, meta = read_delimited(spark, path, dense_ids=True)
    got = [(r.id, r.message, r.rest) for r in raw.orderBy("row_id").collect()]
    assert meta["layouts"][0].multi_line
    assert got == [(a, b.replace('""', '"'), c or None) for a, b, c in rows] + [("901", "\n", None)]
    assert sorted(r.row_id for r in raw.collect()) == list(range(1, 202))
    assert read_records(spark, [path], ",").select("_split").distinct().count() > 10


def test_header_over_lines_and_other_encodings(spark, tmpdir_path, small_splits):
    path = os.path.join(tmpdir_path, "l.csv")
    with open(path, "wb") as f:
        f.write('a,b\n1,"caf\xe9\nol\xe9"\n2,z\n'.encode("latin-1"))
    raw, meta = read_delimited(spark, path)
    assert meta["encoding"] == "ISO-8859-1"
    assert sorted((r.a, r.b) for r in raw.collect()) == [("1", "café\nolé"), ("2", "z")]
    with open(path, "w") as f:
        f.write('a,"b\nb' + "b" * 300 + '"\n1,"x\ny"\n')
    assert [list(r.fields) for r in read_records(spark, [path], ",").collect()] == [["1", "x\ny"]]


def test_odd_quotes_do_not_make_records_longer(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "s.csv")
    with open(path, "w") as f:
        f.write('a,b\n5" pipe,x\n"6"" pipe",y\n7" pipe,"open\ntext"\n')
    assert sorted((r.a, r.b) for r in read_delimited(spark, path)[0].collect()) == [('5" pipe', "x"), ('6" pipe', "y"), ('7" pipe', "open\ntext")]
