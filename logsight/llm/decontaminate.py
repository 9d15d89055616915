"""Benchmark decontamination as a prefix-filtered set join.

Every item gives windows of ten words, every window a set of shingles. A
window that occurs in a document shares all of its shingles with it, so one
necessary shingle is enough to find it: the one rarest in the corpus. Documents
look up those prefixes only; length and position bounds come before the exact
comparison of words over the whole window.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logsight.llm import arrays as A
from logsight.session import stage

#: Bytes of words after lower-casing: digits, letters, and all beyond ASCII.
WORD_TABLE = A.table_of((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SHINGLE = 3


def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, rows = A.runs(data, offsets, WORD_TABLE)
    return starts, ends, rows, A.hash_runs(data, starts, ends, A.LOWER)


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words; sizes differ in the hash."""
    return A.mix(A.Rolling(hashes).windows(size) + np.uint64(size))


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Rows (item, text, n, at, shingle): each window of each item, its words
    joined by spaces, and its shingles with their places in it."""
    source = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item", "text", "n", "at", "shingle"]
        for batch in batches:
            for lo, hi, data, offsets in A.texts(batch, "text"):
                low = A.LOWER[data]
                starts, ends, rows, hashes = _words(data, offsets)
                out: dict[str, list] = {k: [] for k in names}
                first = np.searchsorted(rows, np.arange(hi - lo + 1))
                for r in range(hi - lo):
                    a, b = int(first[r]), int(first[r + 1])
                    n = min(window, b - a)
                    if not n:
                        continue
                    words = [low[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])]
                    size = min(SHINGLE, n)
                    marks = A.signed(_shingles(hashes[a:b], size)).tolist()
                    for k in range(b - a - n + 1):
                        for j in range(n - size + 1):
                            for name, value in zip(names, (batch.column(0)[lo + r].as_py(), " ".join(words[k:k + n]), n, j, marks[k + j])):
                                out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()))], names)

    return source.mapInArrow(work, "item string, text string, n int, at int, shingle long")


class Lookup:
    """Finds the places of given 64-bit keys: a flag table, then a search."""

    def __init__(self, keys: np.ndarray, bits: int = 22):
        self.keys, self.shift = np.sort(keys), np.uint64(64 - bits)
        self.flags = np.zeros(1 << bits, bool)
        self.flags[self.keys >> self.shift] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in values, index of the key at each)."""
        at = np.flatnonzero(self.flags[values >> self.shift])
        k = np.searchsorted(self.keys, values[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == values[at] if len(self.keys) else np.zeros(0, bool)
        return at[hit], k[hit]


def _sizes(keys: DataFrame, limit: int) -> int:
    return max(1, -(-keys.count() // limit))


def _frequencies(docs: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    """(shingle, n_docs) for the documents of each partition, summed later."""
    by_size = {s: np.array([k for k, z in keys if z == s], np.int64).view(np.uint64) for s in sorted({z for _, z in keys})}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = {s: Lookup(k) for s, k in by_size.items()}
        totals = {s: np.zeros(len(k), np.int64) for s, k in by_size.items()}
        for batch in batches:
            for lo, hi, data, offsets in A.texts(batch, "text"):
                _, _, rows, hashes = _words(data, offsets)
                for s, table in looked.items():
                    if len(hashes) < s:
                        continue
                    marks = _shingles(hashes, s)
                    at, k = table.find(marks)
                    whole = rows[at] == rows[at + s - 1]
                    pairs = np.unique(rows[at[whole]] * len(table.keys) + k[whole])
                    totals[s] += np.bincount(pairs % max(len(table.keys), 1), minlength=len(table.keys))
        for s, n in totals.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(A.signed(looked[s].keys[some])), pa.array(n[some])], ["shingle", "n_docs"])

    return docs.select("text").mapInArrow(work, "shingle long, n_docs long")


def _hits(docs: DataFrame, prefixes: list[tuple[int, int, int, int]]) -> DataFrame:
    """Every document with its word count and the places of the prefixes, each
    with as many words around it as its windows reach."""
    by_size = {s: np.array(sorted((np.int64(k).view(np.uint64), b, a) for k, z, b, a in prefixes if z == s), dtype=np.uint64).reshape(-1, 3) for s in sorted({z for _, z, _, _ in prefixes})}
    kind = pa.list_(pa.struct([("prefix", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.string()))]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = {s: (Lookup(k[:, 0]), k[:, 1].astype(np.int64), k[:, 2].astype(np.int64)) for s, k in by_size.items()}
        for batch in batches:
            for lo, hi, data, offsets in A.texts(batch, "text"):
                starts, ends, rows, hashes = _words(data, offsets)
                n = np.bincount(rows, minlength=hi - lo)
                first = np.cumsum(n) - n
                found: list[list] = [[] for _ in range(hi - lo)]
                for s, (table, before, after) in looked.items():
                    if len(hashes) < s:
                        continue
                    at, k = table.find(_shingles(hashes, s))
                    whole = rows[at] == rows[at + s - 1]
                    for p, j in zip(at[whole].tolist(), k[whole].tolist()):
                        r = rows[p]
                        a, b = max(int(first[r]), p - int(before[j])), min(int(first[r] + n[r]), p + int(after[j]))
                        words = [A.LOWER[data[starts[i]:ends[i]]].tobytes().decode() for i in range(a, b)]
                        found[r].append({"prefix": int(A.signed(table.keys)[j]), "place": p - int(first[r]), "start": a - int(first[r]), "words": words})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(found, kind)], ["id", "key", "n_words", "hits"])

    return docs.select("id", "key", "text").mapInArrow(work, "id long, key string, n_words long, hits array<struct<prefix: long, place: long, start: long, words: array<string>>>")


def _key(text_col: str) -> Column:
    """A digest that tells texts apart; results follow from the text alone."""
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = 10, keys_at_once: int = 1 << 20,
) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, key (a digest of the text).

    An item of fewer than ``window`` words, but not none, is one window. Keys
    go to the tasks in blocks of at most ``keys_at_once`` (8 MB); a larger
    benchmark takes as many passes over the documents as it has blocks.

    Null and empty texts have no words, items without words no windows; each
    row is judged by its own text, also where ids repeat or are null; items that repeat count once; an empty benchmark hits nothing,
    empty documents give an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), _key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    windows = stage(item_windows(benchmark, item_col, item_text_col, window), "item-windows")
    size = F.least(F.col("n"), F.lit(SHINGLE))
    shingles = windows.select("shingle", size.alias("size")).distinct()
    counted = None
    blocks = _sizes(shingles, keys_at_once)
    for b in range(blocks):
        block = [(r.shingle, r.size) for r in shingles.filter(F.pmod("shingle", F.lit(blocks)) == b).collect()]
        part = _frequencies(docs, block)
        counted = part if counted is None else counted.unionByName(part)
    rarity = counted.groupBy("shingle").agg(F.sum("n_docs").alias("n_docs"))
    # windows with a shingle that no document has are out; of the others the rarest shingle is the prefix
    ranked = windows.select("text", "n", "at", "shingle").distinct().join(rarity, "shingle", "left")
    chosen = ranked.groupBy("text", "n").agg(
        F.min(F.coalesce("n_docs", F.lit(0))).alias("least"), F.min(F.struct(F.coalesce("n_docs", F.lit(0)).alias("d"), "shingle", "at")).alias("p"))
    chosen = stage(chosen.filter("least > 0").select("text", "n", F.col("p.shingle").alias("prefix"), F.col("p.at").alias("at")), "prefixes")
    extents = chosen.groupBy("prefix", size.alias("size")).agg(F.max("at").alias("before"), F.max(F.col("n") - F.col("at")).alias("after"))
    blocks = _sizes(extents, keys_at_once)
    first, rest = None, None
    for b in range(blocks):
        block = [(r.prefix, r["size"], r.before, r.after) for r in extents.filter(F.pmod("prefix", F.lit(blocks)) == b).collect()]
        part = stage(_hits(docs, block), f"hits-{b}")
        first = first if first is not None else part
        rest = part if rest is None else rest.unionByName(part)
    # what is found belongs to a text, whichever rows hold it
    hits = rest.select("key", "n_words", F.explode("hits").alias("h")).select("key", "n_words", "h.*")
    placed = hits.join(chosen, "prefix").withColumn("begin", F.col("place") - F.col("at"))
    placed = placed.filter((F.col("begin") >= 0) & (F.col("begin") + F.col("n") <= F.col("n_words")))
    same = F.concat_ws(" ", F.slice("words", (F.col("begin") - F.col("start") + 1).cast("int"), F.col("n")))
    found = stage(placed.filter(same == F.col("text")).select("key", "text", "begin", (F.col("begin") + F.col("n")).alias("end")).distinct(), "occurrences")

    earlier = Window.partitionBy("key").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("key", "begin", "end").distinct().withColumn("seen", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    n_hit = spans.groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("begin", "seen"))).cast("long").alias("n_hit"))
    items = found.select("key", "text").distinct().join(windows.select("item", "text").distinct(), "text").select("key", "item").distinct()
    items = items.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = first.select("id", "key", "n_words").join(n_hit, "key", "left").join(items, "key", "left")
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` without the rows whose text holds a window of a benchmark item."""
    found = decontaminate(docs, benchmark, id_col, text_col, **limits)
    gone = found.filter("contaminated").select(F.col("key").alias("__key__")).distinct()
    return docs.join(gone, _key(text_col) == F.col("__key__"), "left_anti")
