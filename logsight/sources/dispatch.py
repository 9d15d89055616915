"""Read any mix of inputs into canonical events (SRC4, SRC9).

Paths are grouped by suffix; each group is read by its own source, mapped to
the canonical schema and the groups are united by name.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsight.constants import CANONICAL_COLUMNS
from logsight.functions.lineparse import parse_lines, to_canonical_events
from logsight.operators.columns import to_canonical
from logsight.session import stage
from logsight.sources.delimited import find_layouts, numbered, read_group
from logsight.sources.logs import read_log_lines
from logsight.sources.rowid import dense_numbers
from logsight.sources.workbooks import read_workbooks, workbook_frame

DETECTED = {".log": "log lines", ".csv": "delimited text", ".xlsx": "workbook"}


def read_events(spark: SparkSession, paths: list[str], as_log: bool = False,
                dense_ids: bool = False) -> tuple[DataFrame, dict]:
    """Canonical events from .log / .csv / .xlsx paths (``as_log`` reads
    delimited files as raw log lines). Returns (events, metadata). Delimited
    files are mapped layout by layout, so each keeps its own header. ``row_id`` is
    unique over all inputs; with ``dense_ids`` it counts 1..n, in file order per kind."""
    kinds: dict[str, list[str]] = {}
    for p in paths:
        ext = os.path.splitext(p.lower())[1]
        kinds.setdefault(".log" if as_log and ext == ".csv" else ext, []).append(p)
    frames, meta = [], {}
    for ext, group in sorted(kinds.items()):
        parts = []
        if ext == ".log":
            parts.append(to_canonical_events(parse_lines(read_log_lines(spark, group, dense_ids=dense_ids))))
        elif ext == ".csv":
            layouts = find_layouts(spark, group)
            for g in layouts:
                raw = numbered(read_group(spark, g, consecutive=dense_ids), dense_ids)
                df, found = to_canonical(raw)
                parts.append(df)
                meta.setdefault(ext, {"layouts": [g.layout for g in layouts], **found})
        elif ext == ".xlsx":
            df, meta[ext] = to_canonical(workbook_frame(read_workbooks(spark, group)).drop("file_path", "sheet"))
            parts.append(df)
        else:
            raise ValueError(f"unsupported input type: {ext}")
        frames += [df.withColumn("detected_type", F.lit(DETECTED[ext])) for df in parts]
    out = frames[0].withColumn("_part", F.lit(0))
    for k, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("_part", F.lit(k)), allowMissingColumns=True)
    if dense_ids:
        return dense_numbers(stage(out, "events"), ["_part", "row_id"]).drop("_part"), meta
    return out.drop("_part").withColumn("row_id", F.monotonically_increasing_id()), meta


def training_frame(df: DataFrame, label: str = "label") -> DataFrame:
    """SRC9: labelled rows -> canonical frame (label -> label_original,
    missing canonical columns added as typed nulls, an absent row_id as 1..n)."""
    out = df.withColumnRenamed(label, "label_original")
    if "row_id" not in out.columns:
        out = dense_numbers(stage(out.withColumn("row_id", F.monotonically_increasing_id()), "training"), ["row_id"])
    types = {"dst_port": "double", "bytes": "double", "duration": "double"}
    for c in CANONICAL_COLUMNS + ["ts_raw"]:
        if c == "timestamp":
            continue
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(types.get(c, "string")))
    return out
