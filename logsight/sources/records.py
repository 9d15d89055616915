"""Quoted records of delimited text, cut in parallel.

A quoted field may hold line breaks, so whether a line starts a record depends
on all lines before it. Each line is a function on one bit (inside a quoted field or not), worked out
both ways from the line alone. The lines of a split compose to such a function too; a running
composition over the splits of a file, one row a split, gives the state at the
start of each. Every split is then cut into records by its own task, and the few records
that lie across splits are put together from their parts.

Fields follow Python's csv rules: a quote opens a field only at its start, two quotes
inside are one, what follows a closing quote is taken as it is, and a lone carriage return
outside quotes ends a record. A quote that nothing in its file closes opens nothing: the lines from there on are
records of their own.
"""
from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsight.functions.text import strip_ws
from logsight.session import stage

#: Encodings in which a line feed is one byte that means nothing else.
SPLITTABLE = {"UTF-8", "ISO-8859-1", "US-ASCII", "WINDOWS-1252"}
#: Up to so many splits that start inside a field (or need a mark) are broadcast; beyond that lines are dealt by split.
BROADCAST_SPLITS = 100_000

_RECORD = "fields array<string>, text string, _file string, _split long, _mono long, nth int, part int"
_ROW = "fields array<string>, _file string, _split long, _mono long, nth int"
WHOLE, HEAD, MIDDLE, TAIL = range(4)


def opens(line: Column, separator: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted field: when it starts outside, and when it starts inside of one."""
    end = f"[{re.escape(separator)}\\r]"
    rest = f"[^{re.escape(separator)}\\r]*+"
    inner = '[^"]*+(?:""[^"]*+)*+'
    # whole fields, then a quoted one without its end
    opening = f'(?:(?:"{inner}"{rest}|(?!"){rest}){end})*+"{inner}\\z'
    quoted = line.contains('"')
    return (F.when(quoted, line.rlike(f"^{opening}")).otherwise(F.lit(False)),
            F.when(quoted, line.rlike(f'^{inner}(?:\\z|"{rest}{end}{opening})')).otherwise(F.lit(True)))


def text_lines(spark: SparkSession, files: list[str], encoding: str) -> DataFrame:
    """(value, _file, _split, _mono): lines up to the line feed, decoded; a byte order mark goes."""
    lines = spark.read.option("lineSep", "\n").text(files).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_mono"))
    if encoding.upper() != "UTF-8":
        lines = lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    return lines.withColumn("value", F.regexp_replace("value", "^﻿", "")) if encoding.upper() == "UTF-8" else lines


def _after(fresh: np.ndarray, inside: np.ndarray, state: bool) -> np.ndarray:
    """The state after each line, from the state before the first: lines that end
    alike either way set it, those that swap it turn it over."""
    at = np.arange(len(fresh))
    known = np.maximum.accumulate(np.where(fresh == inside, at, -1))
    turns = np.cumsum(fresh & ~inside)
    since = turns - np.where(known >= 0, turns[known], 0)
    return np.where(known >= 0, fresh[known], state) ^ (since % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch by (file, split), in order."""
    split = batch.column("_split").to_numpy()
    file = batch.column("_file").dictionary_encode()
    code = file.indices.to_numpy()
    cuts = (np.flatnonzero((split[1:] != split[:-1]) | (code[1:] != code[:-1])) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(split)]):
        if a < b:
            yield (file.dictionary[int(code[a])].as_py(), int(split[a])), batch.slice(a, b - a)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (file, split): its end state from either start, and
    whether a field that is open at its start is closed in it."""
    at, ends, closes = None, (False, True), False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"_file": at[0], "_split": at[1], "fresh": bool(ends[0]), "inside": bool(ends[1]), "closes": closes}])

    for batch in batches:
        for key, part in _runs(batch):
            if key != at:
                if at:
                    yield row()
                at, ends, closes = key, (False, True), False
            fresh, inside = (part.column(c).to_numpy(zero_copy_only=False) for c in ("fresh", "inside"))
            states = [_after(fresh, inside, e) for e in ends]
            ends, closes = tuple(x[-1] for x in states), closes or not states[1].all()
    if at:
        yield row()


def split_states(lines: DataFrame) -> DataFrame:
    """(_file, _split, open, loose, header): whether a split starts inside a field,
    whether the field open at its end is never closed, and whether the file's header is here.
    Splits of which nothing is to be told are left out."""
    quoted = lines.filter("quoted").select("_file", "_split", "fresh", "inside").mapInArrow(_summaries, "_file string, _split long, fresh boolean, inside boolean, closes boolean")
    # splits can share a task, and a split is in one task: still one row each
    worded = lines.groupBy("_file", "_split").agg(F.bool_or("worded").alias("worded"))
    each = worded.join(quoted, ["_file", "_split"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))).withColumn("inside", F.coalesce("inside", F.lit(True)))
    each = each.withColumn("closes", F.coalesce("closes", F.lit(False)))
    each = stage(each, "splits")
    # windows over one row a split
    order = Window.partitionBy("_file").orderBy("_split")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    known = each.withColumn("same", (F.col("fresh") == F.col("inside")).cast("int")).withColumn("group", F.sum("same").over(upto))
    in_group = Window.partitionBy("_file", "group").orderBy("_split").rowsBetween(Window.unboundedPreceding, 0)
    turned = F.when(F.col("same") == 1, F.col("fresh")).otherwise(F.col("fresh") & ~F.col("inside")).cast("int")
    state = known.withColumn("after", F.sum(turned).over(in_group) % 2 == 1)
    state = state.withColumn("open", F.coalesce(F.lag("after").over(order), F.lit(False)))
    later = F.coalesce(F.bool_or("closes").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(False))
    state = state.withColumn("loose", F.col("after") & ~later)
    first = F.min(F.when(F.col("worded"), F.col("_split"))).over(Window.partitionBy("_file"))
    state = state.withColumn("header", F.coalesce(F.col("_split") == first, F.lit(False)))
    return stage(state.filter("open OR loose OR header").select("_file", "_split", "open", "loose", "header"), "split-states")


def _fields(records: list[str], separator: str) -> tuple[list[list[str]], list[int]]:
    """The fields of records, and which record each came from (a lone carriage return cuts one into more)."""
    csv.field_size_limit(sys.maxsize)
    records = [r[:-1] if r.endswith("\r") else r for r in records]
    if not any("\r" in r for r in records):
        return list(csv.reader(iter(records), delimiter=separator)), list(range(len(records)))
    out, of = [], []
    for k, r in enumerate(records):
        for fields in csv.reader(io.StringIO(r, newline="") if "\r" in r else [r], delimiter=separator):
            out.append(fields)
            of.append(k)
    return out, of


def _nth(of: list[int]) -> list[int]:
    """Positions among rows of one origin, which stand together."""
    out: list[int] = []
    for k, x in enumerate(of):
        out.append(out[-1] + 1 if k and of[k - 1] == x else 0)
    return out


def _loose_fields(line: str, separator: str) -> list[list[str]]:
    """Fields of a line whose open quote means nothing."""
    return [part.split(separator) for part in re.split("\r", line[:-1] if line.endswith("\r") else line)]


def _cutter(separator: str):
    """Task function: the lines of whole splits in order -> records and parts of records."""

    def rows(records: list[str], monos: list[int], key: tuple[str, int]) -> pa.RecordBatch:
        fields, of = _fields(records, separator)
        return batch_of(fields, [None] * len(fields), key, [monos[k] for k in of], WHOLE, _nth(of))

    def batch_of(fields: list, texts: list, key: tuple[str, int], monos: list[int], part: int, nth: list[int] | None = None) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array(fields, pa.list_(pa.string())), pa.array(texts, pa.string()), pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(monos, pa.int64()), pa.array(nth or [0] * n, pa.int32()), pa.array([part] * n, pa.int32())],
            ["fields", "text", "_file", "_split", "_mono", "nth", "part"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        state = loose = headed = False
        held: list[str] = []  # lines of the record that is open
        held_at, began_open = 0, False

        def close() -> Iterator[pa.RecordBatch]:
            """What a split leaves open."""
            if not held:
                return
            if not headed and held[0].strip(" \t\r\n"):  # the header itself
                if loose:
                    held.pop(0)
                else:
                    return
            if loose:
                found = [(f, held_at + k) for k, line in enumerate(held) if line.strip(" \t\r\n") for f in _loose_fields(line, separator)]
                yield batch_of([f for f, _ in found], [None] * len(found), at, [m for _, m in found], WHOLE, _nth([m for _, m in found]))
            else:
                yield batch_of([None], ["\n".join(held)], at, [held_at], MIDDLE if began_open else TAIL)

        for batch in batches:
            for key, part in _runs(batch):
                if key != at:
                    if at:
                        yield from close()
                    at, held, began_open = key, [], False
                    state, loose = (bool(part.column(c)[0].as_py()) for c in ("open", "loose"))
                    headed = not part.column("header")[0].as_py()
                    began_open = state
                    held_at = part.column("_mono")[0].as_py()
                values, mono = part.column("value").to_pylist(), part.column("_mono").to_numpy()
                after = _after(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("fresh", "inside")), state)
                ends = np.flatnonzero(~after).tolist()  # records end here
                state = bool(after[-1])
                lo, records, monos = 0, [], []
                for e in ends:
                    if held:
                        text, first = "\n".join([*held, *values[lo:e + 1]]), held_at
                        held = []
                    else:
                        text, first = (values[lo] if e == lo else "\n".join(values[lo:e + 1])), int(mono[lo])
                    lo = e + 1
                    if began_open:
                        began_open = False
                        yield batch_of([None], [text], key, [first], HEAD)
                    elif text.strip(" \t\r\n") == "":
                        continue
                    elif not headed:
                        headed = True
                    else:
                        records.append(text)
                        monos.append(first)
                if lo < len(values):
                    if not held:
                        held_at = int(mono[lo])
                    held.extend(values[lo:])
                if records:
                    yield rows(records, monos, key)
        if at:
            yield from close()

    return work


def _parsed(separator: str):
    """Task function: records put together -> their fields."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, of = _fields(batch.column("text").to_pylist(), separator)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(fields, pa.list_(pa.string())), *(batch.column(c).take(at) for c in ("_file", "_split", "_mono")), pa.array(_nth(of), pa.int32())], ["fields", "_file", "_split", "_mono", "nth"])

    return work


def read_records(spark: SparkSession, files: list[str], separator: str, encoding: str = "UTF-8") -> DataFrame:
    """(fields, _file, _split, _mono, nth): the records of the files without their headers and without blank ones.

    A file is read by as many tasks as it has splits. Besides the lines, one row a
    split moves, and the texts of records that lie across splits. ``files`` are in an encoding of ``SPLITTABLE``.
    """
    lines = text_lines(spark, files, encoding)
    fresh, inside = opens(F.col("value"), separator)
    lines = lines.withColumn("fresh", fresh).withColumn("inside", inside)
    told = split_states(lines.select("_file", "_split", "fresh", "inside", F.col("value").contains('"').alias("quoted"), (strip_ws(F.col("value")) != "").alias("worded")))
    if told.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        lines = lines.join(F.broadcast(told), ["_file", "_split"], "left")
    else:
        # a split is a bounded number of lines
        lines = lines.join(told, ["_file", "_split"], "left").repartition("_file", "_split").sortWithinPartitions("_file", "_split", "_mono")
    lines = lines.select("value", "_file", "_split", "_mono", "fresh", "inside", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("open", "loose", "header")))
    # (_file, _split, _mono, nth) is the order of the records
    cut = stage(lines.mapInArrow(_cutter(separator), _RECORD), "records")
    whole = cut.filter(F.col("part") == WHOLE).select("fields", "_file", "_split", "_mono", "nth")
    parts = cut.filter(F.col("part") != WHOLE).select("text", "_file", "_split", "_mono", "part")
    # a record's parts: from a tail to the head after it; one row a part
    order = Window.partitionBy("_file").orderBy("_split", "part").rowsBetween(Window.unboundedPreceding, 0)
    chain = parts.select("_file", "_split", "part").withColumn("chain", F.sum((F.col("part") == TAIL).cast("int")).over(order))
    # before the first tail of a file only its header can end
    joined = parts.join(chain.filter("chain > 0"), ["_file", "_split", "part"]).groupBy("_file", "chain").agg(
        F.sort_array(F.collect_list(F.struct("_split", "_mono", "text"))).alias("p"))
    across = joined.select(F.concat_ws("\n", F.col("p.text")).alias("text"), "_file", F.col("p")[0]["_split"].alias("_split"), F.col("p")[0]["_mono"].alias("_mono"))
    return whole.unionByName(across.mapInArrow(_parsed(separator), _ROW))
