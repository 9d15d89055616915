"""Sinks (SNK1, SNK2).

Result tables are written as parquet, partitioned by ``run_id``; the scored
event table is additionally partitioned by event date so later detection
queries prune partitions. Spreadsheet exports neutralise formula injection.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsight.functions.text import spreadsheet_safe
from logsight.functions.timestamps import format_seconds


def write_results(tables: dict[str, DataFrame], base_path: str, run_id: str) -> dict[str, str]:
    """Write each result table under ``base_path/<name>/run_id=<id>``. A run
    owns that folder: writing it again replaces it."""
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"run ids are letters, digits, '_', '.' and '-': {run_id!r}")
    out = {}
    for name, df in tables.items():
        path = f"{base_path.rstrip('/')}/{name}"
        if name == "scored" and "ts_sec" in df.columns:
            df = df.withColumn("event_date", F.coalesce(format_seconds("ts_sec", "yyyy-MM-dd"), F.lit("none")))
            df.write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/run_id={run_id}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")
        out[name] = path
    return out


def to_spreadsheet_safe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """SNK2: make text cells safe to open in a spreadsheet."""
    cols = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    for c in cols:
        df = df.withColumn(c, spreadsheet_safe(c))
    return df


def write_csv_safe(df: DataFrame, path: str) -> str:
    to_spreadsheet_safe(df).write.mode("overwrite").option("header", True).csv(path)
    return path
