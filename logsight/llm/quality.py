"""Quality rules with cross-document line frequency.

One pass over the texts measures each document and hashes its normalised
lines; a count of distinct documents per (host, line) finds boilerplate; lines
over the limit count as removed, and a document that keeps too little is
rejected.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logsight.llm import arrays as A
from logsight.session import stage

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_FACTS = "id long, host string, key string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, digest long, lines array<long>, words array<int>"


def _key(text_col: str) -> Column:
    """A digest that tells texts apart."""
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _flags(text: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(text.encode())] = True
    return flags


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Flags keys that occur twice or more."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = A.runs(data, offsets, A.WORD_BYTES)
    raw = A.hash_runs(data, starts, ends)
    low = A.hash_runs(data, starts, ends, A.LOWER)
    n_words = np.bincount(rows, minlength=n)
    chars = A.WORD_BYTES[data] & ((data & 0xC0) != 0x80)
    salt = A.mix(np.arange(1, n + 1, dtype=np.uint64))

    windows = A.Rolling(raw).windows(WINDOW)
    whole = np.flatnonzero(rows[:len(windows)] == rows[WINDOW - 1:]) if len(windows) else np.zeros(0, np.int64)
    twice = whole[_repeats(windows[whole] ^ salt[rows[whole]])]
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0

    l_start, l_end, l_row = A.runs(data, offsets, A.LINE_BYTES)
    first, stop = np.searchsorted(starts, l_start), np.searchsorted(starts, l_end)
    worded = stop > first
    l_start, l_end, l_row, first, stop = (x[worded] for x in (l_start, l_end, l_row, first, stop))
    exact = A.hash_runs(data, l_start, l_end) ^ salt[l_row]
    kinds, at = np.unique(exact, return_index=True)
    n_dup = np.bincount(l_row, minlength=n) - np.bincount(l_row[at], minlength=n)
    lines = A.Rolling(low).spans(first, stop)

    # which document this is, whoever copied it: all of its words
    row = np.arange(n)
    digest = A.Rolling(low).spans(np.searchsorted(rows, row), np.searchsorted(rows, row, "right"))
    return {
        "n_words": n_words, "word_chars": _per_row(chars, offsets), "n_symbols": _per_row(_flags(SYMBOLS)[data], offsets),
        "n_dup_lines": n_dup, "n_repeat_words": np.bincount(rows[repeated], minlength=n), "digest": A.signed(digest),
        "lines": (np.concatenate([[0], np.cumsum(np.bincount(l_row, minlength=n))]), A.signed(lines), (stop - first)),
    }


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in A.texts(batch, "text"):
            got = _measure(data, offsets)
            at, lines, words = got.pop("lines")
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(lo, hi - lo) for c in range(3)), *(pa.array(x, pa.int64()) for x in got.values()),
                 pa.ListArray.from_arrays(at, pa.array(lines, pa.int64())), pa.ListArray.from_arrays(at, pa.array(words, pa.int32()))],
                ["id", "host", "key", *got, "lines", "words"])


def _judge(
    docs: DataFrame, id_col: str, text_col: str, host_col: str, min_words: int, max_repeat_percent: int, max_line_documents: int, max_line_percent: float, min_kept_percent: int, min_kept_words: int,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, frequent lines, the lines each document loses)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), _key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    # written once, so that a row keeps its number: ids may repeat or be null
    facts = stage(source.mapInArrow(_facts, _FACTS).withColumn("row", F.monotonically_increasing_id()), "quality")
    hosted = F.coalesce(F.col("host"), F.lit("")).alias("host")
    lines = facts.select("row", "key", hosted, "digest", F.explode(F.arrays_zip("lines", "words")).alias("l"))
    lines = lines.select("row", "key", "host", "digest", F.col("l.lines").alias("line"), F.col("l.words").alias("words"))
    sizes = facts.select(hosted, "digest").distinct().groupBy("host").agg((F.count("*") * max_line_percent / 100).alias("share"))
    common = (
        lines.groupBy("host", "line", "digest").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("n_docs"))
        .filter(F.col("n_docs") > max_line_documents).join(sizes, "host").filter(F.col("n_docs") > F.col("share"))
    )
    common = stage(common.select("host", "line", "n_docs"), "common-lines")
    hit = lines.join(common.select("host", "line"), ["host", "line"])
    removed = hit.groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    rows = facts.drop("lines", "words", "digest").join(removed, "row", "left").drop("row")
    rows = rows.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < min_kept_words) | (100 * left < min_kept_percent * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted), common, hit


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *,
    min_words: int = 20, max_repeat_percent: int = 30, max_line_documents: int = 10, max_line_percent: float = 1.0, min_kept_percent: int = 30, min_kept_words: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, frequent lines).

    Verdicts: one row per document with its measures, ``base_failed``,
    ``n_removed_words`` (words on lines over the limit) and ``kept``. A line is
    over the limit if more distinct documents of its host hold it than
    ``max_line_documents`` and than ``max_line_percent`` of the host's
    distinct documents. Rows with the same words in the same order, letter
    case and white space aside, are one document in both counts, so a mirrored
    page does not make its own lines boilerplate. A document is depleted, and rejected, if fewer than
    ``min_kept_words`` words or ``min_kept_percent`` of its words remain.

    Null texts have no words and fail the base rule; a null host is one host,
    together with the empty one; each row is judged by its own text and host, also
    where ids repeat or are null; an empty
    table gives an empty result; other columns are not read.
    """
    rows, common, _ = _judge(docs, id_col, text_col, host_col, min_words, max_repeat_percent, max_line_documents, max_line_percent, min_kept_percent, min_kept_words)
    return rows.drop("host", "key").withColumnRenamed("id", id_col), common


def _without(text: str, gone: set[int]) -> str:
    """The text without its lines whose normalised hash is in ``gone``."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = A.runs(data, np.array([0, len(data)]), A.WORD_BYTES)
    low = A.Rolling(A.hash_runs(data, starts, ends, A.LOWER))
    breaks = np.flatnonzero(data == 10)
    begin, stop = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    names = A.signed(low.spans(first, last)).tolist()
    whole = data.tobytes()
    return b"\n".join(whole[a:b] for a, b, n, p, q in zip(begin.tolist(), stop.tolist(), names, first.tolist(), last.tolist()) if p == q or n not in gone).decode()


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", length_col: str | None = None, **limits) -> DataFrame:
    """The documents that the rules keep, without their lines over the limit;
    columns as in ``docs``, ``length_col`` set anew where lines went. Verdicts and lines
    follow from a row's text and host, whatever its id."""
    defaults = dict(min_words=20, max_repeat_percent=30, max_line_documents=10, max_line_percent=1.0, min_kept_percent=30, min_kept_words=10)
    rows, _, hit = _judge(docs, id_col, text_col, host_col, **(defaults | limits))
    gone = hit.groupBy("key", "host").agg(F.collect_set("line").alias("gone"))
    kept = rows.filter("kept").select("key", F.coalesce("host", F.lit("")).alias("host")).distinct().join(gone, ["key", "host"], "left")
    kept = stage(kept.select(F.col("key").alias("__key__"), F.col("host").alias("__host__"), F.col("gone").alias("__gone__")), "kept")
    at, size = docs.columns.index(text_col), docs.columns.index(length_col) if length_col else -1
    host = F.coalesce(docs[host_col].cast("string"), F.lit(""))
    both = docs.join(kept, (_key(text_col) == kept["__key__"]) & (host == kept["__host__"])).drop("__key__", "__host__")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            gone, old = columns.pop(), batch.column(at).to_pylist()
            new = [_without(t, set(g)) if t and g else t for t, g in zip(old, gone.to_pylist())]
            columns[at] = pa.array(new, columns[at].type)
            if size >= 0:
                columns[size] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[size].to_pylist(), old, new)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return both.mapInArrow(work, docs.schema)
