"""What recurs: candidate stretches found by content-defined anchors.

A window is a fixed number of consecutive units (words or bytes) of one
document. Equal windows have the same anchor, so a window whose anchor occurs
once in the corpus occurs once. The windows that one anchor serves in one place are a stretch; a
stretch is named by the hash of its anchor and its own hash.

Documents are written once with a number for each row and dealt to blocks of
bounded size by a hash of that number, so that rows with equal or null ids or equal texts
spread. What a block needs to know comes to it as rows in front of its documents: no set of
keys is broadcast, and no key gathers rows of the corpus.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logsight.llm import arrays as A
from logsight.session import stage

DOCUMENT = 9
#: Text bytes of a block: what is known about a block is held in one worker.
BLOCK_BYTES = 64 << 20
_FIELDS = "block int, kind int, id long, a long, b long, text string, data binary"


class Stretches:
    """The stretches of a run of texts: their windows and hashes, by unit index.

    With ``parts`` over 1 a stretch is cut where the place of the anchor in its
    windows passes from one part of the window to the next, and the units that all windows with the
    anchor in that part have in common take the anchor's place as its name: equal windows still agree
    on it, and fewer of those that differ do."""

    def __init__(self, units: np.ndarray, rows: np.ndarray, window: int, gram: int, parts: int = 1):
        rolling = A.Rolling(units)
        self.grams = rolling.windows(gram)
        width, m = window - gram + 1, max(0, len(units) - window + 1)
        whole = np.flatnonzero(rows[:m] == rows[window - 1:]) if m else np.zeros(0, np.int64)
        self.at, self.first, self.last = A.anchors(self.grams, width, whole)
        self.anchor = self.grams[self.at]
        if parts > 1:
            step = -(-width // parts)
            cut = []
            for k in range(parts):
                first, last = np.maximum(self.first, self.at - (k + 1) * step + 1), np.minimum(self.last, self.at - k * step)
                some = np.flatnonzero(first <= last)
                core = self.at[some] - k * step
                cut.append((self.at[some], first[some], last[some], rolling.spans(core, core - step + 1 + window)))
            self.at, self.first, self.last, self.anchor = (np.concatenate(c) for c in zip(*cut))
        self.name = rolling.spans(self.first, self.last + window)
        self.rolling, self.rows, self.window = rolling, rows, window


class Around:
    """The stretches whose anchors start at the given units, from the units
    around each only: the windows in which no other gram is less (or equal and further left)."""

    CHUNK = 1 << 15

    def __init__(self, rolling: A.Rolling, rows: np.ndarray, at: np.ndarray, window: int, gram: int):
        at = at[rows[at] == rows[at + gram - 1]]
        grams = rolling.windows(gram)
        bits = max(24, len(grams).bit_length())
        order = grams >> np.uint64(bits)
        reach = np.arange(1, window - gram + 1)
        first, last = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for lo in range(0, len(at), self.CHUNK):
            p = at[lo:lo + self.CHUNK]
            begin, end = np.searchsorted(rows, rows[p]), np.searchsorted(rows, rows[p], "right")
            left = np.minimum(p - begin, window - gram)
            right = np.minimum(end - gram - p, window - gram)
            mine = order[p][:, None]
            less = (order[np.maximum(p[:, None] - reach, 0)] <= mine) & (reach <= left[:, None])
            left = np.where(less.any(axis=1), less.argmax(axis=1), left)
            less = (order[np.minimum(p[:, None] + reach, len(order) - 1)] < mine) & (reach <= right[:, None])
            right = np.where(less.any(axis=1), less.argmax(axis=1), right)
            first[lo:lo + self.CHUNK] = p - left
            last[lo:lo + self.CHUNK] = np.minimum(p, p + right + gram - window)
        some = first <= last
        self.at, self.first, self.last = at[some], first[some], last[some]
        self.anchor = grams[self.at]
        self.name = rolling.spans(self.first, self.last + window)


def join_name(anchor: np.ndarray, name: np.ndarray) -> np.ndarray:
    return A.mix(anchor * np.uint64(0x9E3779B97F4A7C15) + name)


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, id_col: str, text_col: str, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, id, text). Every row is written with a number of its own, so
    that it stays in its block however often it is read. There are as many
    blocks as shuffle partitions at least, and more where they would hold over ``block_bytes`` of text on average."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    docs = stage(docs.select(F.monotonically_increasing_id().alias("row"), "id", F.octet_length("text").alias("size"), "text"), f"{name}-documents")
    blocks = max(partitions_of(docs), -(-(docs.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    return docs.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "id", "text")


def recurring(docs: DataFrame, stretches: Callable[[np.ndarray, np.ndarray], Iterator[Stretches]], name: str) -> tuple[DataFrame, DataFrame]:
    """(places, kinds). Places: each (block, anchor, name) of stretches whose
    anchor occurs twice or more, with their number ``n`` there. Kinds: each distinct (anchor, name) of them with its
    count ``n``, the blocks ``home`` and ``other`` that hold one (the same if no two do), and ``mixed``: whether
    its anchor has other stretches too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            for lo, _, data, offsets in A.texts(batch, "text"):
                for s in stretches(data, offsets):
                    yield pa.RecordBatch.from_arrays([pa.array(block[lo:][s.rows[s.first]]), pa.array(A.signed(s.anchor)), pa.array(A.signed(s.name))], ["block", "anchor", "name"])

    found = stage(docs.select("block", "text").mapInArrow(work, "block int, anchor long, name long"), f"{name}-anchors")
    # each side of a join is a table of its own, and no join feeds a grouping by its
    # keys: Spark can then split the tasks of a hot anchor
    often = stage(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), f"{name}-often")
    again = stage(found.join(often, "anchor", "left_semi"), f"{name}-again")
    places = stage(again.groupBy("block", "anchor", "name").agg(F.count("*").alias("n")), f"{name}-places")
    kinds = stage(places.groupBy("anchor", "name").agg(F.sum("n").alias("n"), F.min("block").alias("home"), F.max("block").alias("other")), f"{name}-kinds")
    mixed = stage(kinds.groupBy("anchor").agg(F.count("*").alias("names")).select("anchor", (F.col("names") > 1).alias("mixed")), f"{name}-mixed")
    return places, stage(kinds.join(mixed, "anchor"), f"{name}-mixed-kinds")


def known(df: DataFrame, kind: int, block: str = "block", **columns: str) -> DataFrame:
    """Rows for ``by_block``: what ``df`` tells each block."""
    have = {"block": F.col(block).cast("int"), "kind": F.lit(kind)} | {k: F.col(v) for k, v in columns.items()}
    return df.select(*(have.get(k, F.lit(None)).cast(t).alias(k) for k, t in (f.split() for f in _FIELDS.split(", "))))


def by_block(docs: DataFrame, facts: list[DataFrame], use: Callable[[int, dict[int, pa.Table]], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """Streams the documents of each block past what the block knows. ``use``
    gets the facts of a block by kind and returns what to do with batches of its documents."""
    rows = known(docs, DOCUMENT, id="id", text="text")
    for f in facts:
        rows = rows.unionByName(f)
    partitions = partitions_of(docs)
    rows = rows.repartitionById(partitions, F.pmod("block", F.lit(partitions))).sortWithinPartitions("block", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, do = None, [], None
        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(block)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if block[a] != at:
                    at, held, do = block[a], [], None
                if kind[a] != DOCUMENT:
                    held.append((int(kind[a]), part.select(["a", "b", "text", "data"])))
                    continue
                if do is None:
                    kinds = {k for k, _ in held}
                    do = use(int(at), {k: pa.Table.from_batches([p for q, p in held if q == k]) for k in kinds})
                    held = []
                yield from do(part.select(["id", "text"]))

    return rows.mapInArrow(work, schema)


def longs(table: pa.Table | None, column: str) -> np.ndarray:
    return table.column(column).to_numpy().view(np.uint64) if table is not None and table.num_rows else np.zeros(0, np.uint64)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    k = np.searchsorted(ordered, values)
    k[k == len(ordered)] = 0
    return ordered[k] == values
