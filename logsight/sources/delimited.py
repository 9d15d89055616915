"""Lenient delimited-text reader (SRC1, SRC10L).

One pass over the raw lines decides, for every file by itself, its encoding
(UTF-8 if all of its lines are valid, else ISO-8859-1), its header line and
whether a quoted field spans lines. Files that agree in all of that and in
the separator (sniffed from the header, else ',', ';', tab: the first with at least two
fields) are one ``spark.read.csv`` with an all-string schema plus a trailing
``_overflow`` column: over-long rows (a value lands in ``_overflow``) are
dropped, short rows come back null-padded, blank lines vanish, null markers
become null. Files with a quoted field over several lines are cut into records split by split (``records``).
"""
from __future__ import annotations

import csv
import io
import os
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsight import constants as C
from logsight.functions.text import strip_ws
from logsight.sources.records import SPLITTABLE, opens, read_records
from logsight.sources.rowid import dense_row_id, with_row_key

SEPARATORS = (",", ";", "\t")


@dataclass(frozen=True)
class Layout:
    """What files must share to be read together."""
    encoding: str
    separator: str
    columns: tuple[str, ...]
    multi_line: bool


@dataclass
class Group:
    layout: Layout
    files: list[str] = field(default_factory=list)


def header_fields(line: str, sep: str | None = None) -> tuple[str, list[str]]:
    """(separator, fields) of a header line."""
    candidates = [sep] if sep else []
    if not sep:
        try:
            candidates.append(csv.Sniffer().sniff(line, delimiters=",;\t|").delimiter)
        except csv.Error:
            pass
        candidates += [s for s in SEPARATORS if s not in candidates]
    for one in candidates:
        fields = next(csv.reader(io.StringIO(line), delimiter=one))
        if len(fields) >= 2 or sep:
            return one, fields
    return ",", next(csv.reader(io.StringIO(line), delimiter=","))


def find_layouts(spark: SparkSession, paths: list[str], sep: str | None = None,
                 encoding: str | None = None, multi_line: bool | None = None) -> list[Group]:
    """The files below ``paths`` by layout, in order of the first file of each.
    One aggregate over all lines; one row per file reaches the driver, as
    the listing does. Empty files have no layout."""
    lines = with_row_key(spark.read.text(paths))
    worded = strip_ws(F.col("value")) != ""
    each = sorted({sep} if sep else {*SEPARATORS, "|"})
    facts = lines.groupBy("_file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        # a line that leaves a quoted field open, by separator
        *(F.bool_or(opens(F.col("value"), s)[0]).alias(f"open_{k}") for k, s in enumerate(each)),
        F.min_by(F.col("value").cast("binary"), F.when(worded, F.struct("_split", "_mono"))).alias("header"))
    groups: dict[Layout, Group] = {}
    for row in sorted(facts.collect(), key=lambda r: r["_file"]):
        if row["header"] is None:
            continue
        enc = encoding or ("UTF-8" if row["utf8"] else "ISO-8859-1")
        text = bytes(row["header"]).decode("latin-1" if enc == "ISO-8859-1" else enc, "replace").lstrip("\ufeff")
        found, fields = header_fields(text, sep)
        layout = Layout(enc, found, tuple(unique_names(fields)), bool(row[f"open_{each.index(found)}"]) if multi_line is None else multi_line)
        groups.setdefault(layout, Group(layout)).files.append(unquote(row["_file"]))
    return list(groups.values())


def unique_names(header: list[str]) -> list[str]:
    """Blank names -> 'Unnamed: i'; repeats -> 'name.1', 'name.2', ..."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(header):
        name = name if name.strip() else f"Unnamed: {i}"
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        else:
            seen[name] = 0
        out.append(name)
    return out


def read_group(spark: SparkSession, group: Group, consecutive: bool = False) -> DataFrame:
    """The rows of files of one layout, keyed (``_file``, ``_split``, ``_mono``);
    with ``consecutive``, ``_mono`` counts the rows of a split without gaps.
    Only files in an encoding of several bytes a character with quoted line breaks are read unsplit."""
    lay = group.layout
    if lay.multi_line and lay.encoding.upper() in SPLITTABLE:
        rows = read_records(spark, group.files, lay.separator, lay.encoding).filter(F.size("fields") <= len(lay.columns))
        if consecutive:
            # a split is a bounded number of rows
            order = Window.partitionBy("_file", "_split").orderBy("_mono", "nth")
            rows = rows.withColumn("_mono", F.row_number().over(order).cast("long"))
        fields = [F.get("fields", F.lit(k)) for k in range(len(lay.columns))]
        values = [F.when(~f.isin("", *C.NULL_MARKERS), f).alias(n) for f, n in zip(fields, lay.columns)]
        return rows.select(*values, "_file", "_split", "_mono")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in lay.columns) + ", `_overflow` string"
    df = (spark.read.option("header", True).option("enforceSchema", True).option("sep", lay.separator)
          .option("escape", '"').option("encoding", lay.encoding).option("mode", "PERMISSIVE")
          .option("multiLine", lay.multi_line).schema(schema).csv(group.files))
    # keys after the over-long-row filter so ids stay consecutive
    keyed = with_row_key(df.filter(F.col("_overflow").isNull()).drop("_overflow"))
    values = [F.when(~F.col(f"`{n}`").isin(*C.NULL_MARKERS), F.col(f"`{n}`")).alias(n) for n in lay.columns]
    return keyed.select(*values, "_file", "_split", "_mono")


def numbered(df: DataFrame, dense_ids: bool, max_rows_per_file: int | None = None) -> DataFrame:
    """Replace the row key by ``row_id``: unique, or 1..n in file order."""
    if dense_ids or max_rows_per_file is not None:
        from logsight.session import stage
        return dense_row_id(stage(df, "delimited"), max_rows_per_file=max_rows_per_file)
    return df.drop("_file", "_split", "_mono").withColumn("row_id", F.monotonically_increasing_id())


def read_delimited(spark: SparkSession, paths: list[str] | str, sep: str | None = None,
                   encoding: str | None = None, dense_ids: bool = False, max_rows_per_file: int | None = None,
                   multi_line: bool | None = None) -> tuple[DataFrame, dict]:
    """(DataFrame of string columns + row_id, metadata). Files of several
    layouts are united by column name; columns that a file lacks are null."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    groups = find_layouts(spark, paths, sep, encoding, multi_line)
    if not groups:
        raise ValueError(f"no lines under {paths}")
    dense = dense_ids or max_rows_per_file is not None
    df = read_group(spark, groups[0], dense)
    for g in groups[1:]:
        df = df.unionByName(read_group(spark, g, dense), allowMissingColumns=True)
    lay = groups[0].layout
    meta = {"encoding": lay.encoding, "separator": lay.separator, "columns": list(lay.columns),
            "layouts": [g.layout for g in groups], "files": [os.path.basename(f) for g in groups for f in g.files]}
    keys = ["_file", "_split", "_mono"]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in keys], *keys)
    return numbered(df, dense_ids, max_rows_per_file), meta


def read_table_plain(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """SRC10L: a table with header and inferred types, the reader chosen by the
    suffix (.csv: UTF-8, else ISO-8859-1; .parquet, .json, .orc)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kind = os.path.splitext(paths[0].rstrip("/").lower())[1]
    if kind in (".parquet", ".orc", ".json"):
        return spark.read.format(kind[1:]).load(paths)
    if kind == ".xlsx":
        from logsight.sources.workbooks import read_workbooks, workbook_frame
        return workbook_frame(read_workbooks(spark, paths)).drop("file_path", "sheet", "row_id")
    valid = spark.read.text(paths).agg(F.bool_and(F.is_valid_utf8("value"))).first()[0]
    return (spark.read.option("header", True).option("inferSchema", True).option("escape", '"')
            .option("encoding", "UTF-8" if valid in (True, None) else "ISO-8859-1").csv(paths))
