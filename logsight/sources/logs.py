"""Raw log files -> numbered non-blank lines (SRC3).

``spark.read.text`` splits files into lines in parallel (one task per split)
and keeps the bytes of each line, so a file with a line that is not valid
UTF-8 is decoded as ISO-8859-1 line by line, in the same splits.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsight.functions.text import strip_ws
from logsight.session import stage
from logsight.sources.rowid import dense_row_id, with_row_key

#: At most so many file paths are broadcast; beyond that the flags are joined by split.
BROADCAST_FILES = 10_000


def decode_latin1(lines: DataFrame) -> DataFrame:
    """Decode every line of each file that holds invalid UTF-8 as ISO-8859-1."""
    bad = lines.filter(~F.is_valid_utf8("value")).select("_file").distinct().withColumn("_latin", F.lit(True))
    n_bad = bad.limit(BROADCAST_FILES + 1).count()
    if not n_bad:
        return lines
    if n_bad <= BROADCAST_FILES:
        flagged = lines.join(F.broadcast(bad), "_file", "left")
    else:
        # a key per split, so that one large file is not one key
        splits = lines.select("_file", "_split").distinct().join(bad, "_file")
        flagged = lines.join(splits, ["_file", "_split"], "left")
    text = F.when(F.col("_latin"), F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value"))
    return flagged.select(text.alias("value"), "_file", "_split", "_mono")


def read_log_lines(spark: SparkSession, paths: list[str] | str, latin1_fallback: bool = True,
                   dense_ids: bool = False, max_rows_per_file: int | None = None) -> DataFrame:
    """(row_id, value, file_path): the non-blank lines.

    ``row_id`` is unique; with ``dense_ids`` the keyed lines are staged once
    and numbered 1..n in file order (per-split counts + offsets), which
    ``max_rows_per_file`` needs too."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    # keys are assigned after the blank-line filter so ids stay consecutive
    text = with_row_key(spark.read.text(paths).filter(strip_ws(F.col("value")) != ""))
    lines = text.select("value", "_file", "_split", "_mono")
    if latin1_fallback:
        lines = decode_latin1(lines)
    if not dense_ids and max_rows_per_file is None:
        return lines.select(F.col("_mono").alias("row_id"), "value", F.col("_file").alias("file_path"))
    staged = stage(lines.withColumn("file_path", F.col("_file")), "log-lines")
    return dense_row_id(staged, max_rows_per_file=max_rows_per_file).select("row_id", "value", "file_path")
