"""Workbook (.xlsx) sources and checks (SRC2, SRC6).

A directory of workbooks is one ``binaryFile`` scan; each file is unpacked
inside its own task by a ``mapInPandas`` function using only the standard
library (zip + XML). The unit of parallelism is the file; rows come out as
(file_path, sheet, n_sheets, row_no, cells MAP<header, text>), so workbooks
with different headers share one schema.
"""
from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsight import constants as C

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
REL_NS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
ROW_SCHEMA = "file_path string, sheet string, n_sheets int, row_no long, cells map<string,string>"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref or "A").group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _shared_strings(zf: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in zf.namelist():
        return []
    root = ET.fromstring(zf.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in root.findall("m:si", NS)]


def _sheets(zf: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet name, part path) in workbook order."""
    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.iter(f"{REL_NS}Relationship")}
    out = []
    for s in wb.iter(f"{{{NS['m']}}}sheet"):
        rid = s.get(f"{{{NS['r']}}}id")
        t = target.get(rid, "")
        out.append((s.get("name"), t.lstrip("/") if t.startswith("/") else "xl/" + t))
    return out


def _rows(zf: zipfile.ZipFile, part: str, strings: list[str]):
    root = ET.fromstring(zf.read(part))
    for row in root.iter(f"{{{NS['m']}}}row"):
        cells = {}
        for c in row.findall("m:c", NS):
            kind, v = c.get("t"), c.find("m:v", NS)
            if kind == "s" and v is not None:
                val = strings[int(v.text)]
            elif kind == "inlineStr":
                val = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
            elif kind == "b" and v is not None:
                val = "True" if v.text == "1" else "False"
            else:
                val = v.text if v is not None else None
            if val is not None:
                cells[_col_index(c.get("r"))] = val
        yield cells


def read_workbook_bytes(path: str, content: bytes) -> list[tuple]:
    """Rows of the first non-empty sheet (header = first row)."""
    with zipfile.ZipFile(io.BytesIO(content)) as zf:
        strings = _shared_strings(zf)
        sheets = _sheets(zf)
        for name, part in sheets:
            rows = list(_rows(zf, part, strings))
            if len(rows) >= 2 or (rows and name == sheets[-1][0]):
                break
        else:
            return []
    if not rows:
        return []
    width = max(max(r) for r in rows if r) + 1 if any(rows) else 0
    header = [rows[0].get(i) or f"Unnamed: {i}" for i in range(width)]
    out = []
    for n, r in enumerate(rows[1:], start=1):
        if not r:
            continue
        out.append((path, name, len(sheets), n, {header[i]: r.get(i) for i in range(width)}))
    return out


def _parse_batches(batches):
    for pdf in batches:
        recs = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                recs.extend(read_workbook_bytes(path, bytes(content)))
            except (zipfile.BadZipFile, KeyError, ET.ParseError) as exc:
                raise ValueError(f"cannot read workbook {path}: {exc}") from exc
        yield pd.DataFrame(recs, columns=["file_path", "sheet", "n_sheets", "row_no", "cells"])


def read_workbooks(spark: SparkSession, paths: list[str] | str, glob: str = "*.xlsx") -> DataFrame:
    """SRC2: each workbook at or below ``paths`` -> rows of its first non-empty
    sheet. A workbook that cannot be read is an error that names it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths).select("path", "content")
    return files.mapInPandas(_parse_batches, ROW_SCHEMA)


def workbook_frame(rows: DataFrame) -> DataFrame:
    """Spread ``cells`` into columns (the header set is metadata: one distinct
    pass over the map keys, bounded by the number of columns)."""
    keys = [r[0] for r in rows.select(F.explode(F.map_keys("cells"))).distinct().collect()]
    order = sorted(keys)
    return rows.select("file_path", "sheet", F.monotonically_increasing_id().alias("row_id"),
                       *[F.col("cells")[k].alias(k) for k in order])


#: SRC6: what speaks against a workbook, by the entries of its archive.
_FAULTS = {
    "no workbook structure": lambda entries: "[Content_Types].xml" not in {e.filename for e in entries},
    "contains macros": lambda entries: any(e.filename.rsplit("/", 1)[-1] == "vbaProject.bin" for e in entries),
    "inflates beyond the limit": lambda entries: sum(e.file_size for e in entries) > C.MAX_XLSX_DECOMPRESSED,
}


def workbook_fault(content: bytes) -> str | None:
    """The first fault of a workbook's bytes, or None."""
    try:
        entries = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except zipfile.BadZipFile:
        return "not a zip archive"
    return next((name for name, holds in _FAULTS.items() if holds(entries)), None)
