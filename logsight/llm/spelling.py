"""Spelling variants grouped by a bit-sliced position index.

Two words are near if one inserted, deleted or replaced code point makes one of
the other. The vocabulary is dealt to buckets in which near words meet: with ``L``
the length of the shorter word and an error somewhere in the span [s, e) of its
positions, both words share their first ``s`` and their last ``L - e`` letters. A span is halved
as long as its bucket is large; a span of one position holds a bounded number of words.

Each bucket keeps, for every (position, letter), the set of its words that have the
letter there, as bits. All words of a bucket run along their letters at once and
carry the sets of words that agree so far without an error and with one: replaced
(same position), inserted or deleted (the position shifted by one).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsight.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64
#: Cells (rows x words of a bitset) of one step.
_CELLS = 1 << 17


def vocabulary(docs: DataFrame, id_col: str, text_col: str, every: int, min_length: int, min_count: int) -> DataFrame:
    """(word, n): runs of letters, lower-cased; one code point goes where ``every`` divides the run's checksum."""
    # a deletion only shortens: shorter runs cannot become words
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{min_length},}}"), 0)).alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select("id", low.alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select((F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")) if every else F.col("run")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _spans(*spans: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('s', {s}, 'e', {e})" for s, e in spans) + ")"


def _keyed(entries: DataFrame) -> DataFrame:
    """The bucket of an entry: span and the letters outside it."""
    shared = "xxhash64(l, s, e, substring(word, 1, s), substring(word, length(word) - (l - e) + 1, l - e))"
    return entries.withColumn("key", F.expr(shared))


def buckets(words: DataFrame, min_length: int, bucket_size: int) -> DataFrame:
    """(word, n, l, s, e, key): each word as the shorter and as the longer of a
    pair, with the error in either half; spans of large buckets are halved again."""
    both = words.withColumn("l", F.explode(F.expr(f"filter(array(length(word), length(word) - 1), x -> x >= {min_length})")))
    whole = both.withColumn("span", F.explode(F.expr(_spans(("0", "l div 2"), ("l div 2", "l")))))
    entries = stage(_keyed(whole.select("word", "n", "l", F.col("span.s").cast("int").alias("s"), F.col("span.e").cast("int").alias("e"))), "spelling-entries")
    while True:
        # e - s > 1: what one position can hold is bounded
        large = stage(entries.filter("e - s > 1").groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > bucket_size).select("key", F.lit(True).alias("large")), "spelling-large")
        if large.isEmpty():
            return entries
        halves = _spans(("s", "(s + e) div 2"), ("(s + e) div 2", "e"))
        marked = entries.join(large, "key", "left").withColumn("span", F.explode(F.expr(f"CASE WHEN large AND e - s > 1 THEN {halves} ELSE {_spans(('s', 'e'))} END")))
        entries = stage(_keyed(marked.select("word", "n", "l", F.col("span.s").cast("int").alias("s"), F.col("span.e").cast("int").alias("e"))), "spelling-entries")


def near_words(letters: np.ndarray, length: np.ndarray, bucket: np.ndarray, slot: np.ndarray, shorter: int, end: int) -> np.ndarray:
    """For each row the bits of the words of its bucket that are near, by slot.

    ``letters`` has a row of codes for each word, which is ``shorter`` or one
    more letters long; words of one bucket stand together. Pairs that agree in their first ``end`` letters
    are left to the bucket of the other half (``end`` < ``shorter``).
    """
    rows, width = len(letters), int(slot.max()) // 64 + 1
    kinds = int(letters.max()) + 1
    n_buckets = int(bucket[-1]) + 1
    cell, bit = slot // 64, _U(1) << (slot % 64).astype(_U)
    base = bucket * kinds

    def index(at: int) -> np.ndarray:
        """The sets of words with a letter at a position, by bucket and letter."""
        sets = np.zeros((n_buckets * kinds, width), _U)
        if 0 <= at <= shorter:
            there = np.flatnonzero(length > at)
            np.add.at(sets.reshape(-1), (base[there] + letters[there, at]) * width + cell[there], bit[there])  # distinct bits: a sum is a union
        return sets

    def sets_of(which: np.ndarray) -> np.ndarray:
        out = np.zeros((n_buckets, width), _U)
        np.add.at(out.reshape(-1), bucket[which] * width + cell[which], bit[which])
        return out

    low, high = np.flatnonzero(length == shorter), np.flatnonzero(length > shorter)
    short, long = sets_of(low), sets_of(high)
    near = np.zeros((rows, width), _U)
    everyone = short | long
    same_l, same_h = everyone[bucket[low]], everyone[bucket[high]]
    replaced, inserted, deleted = np.zeros_like(same_l), np.zeros_like(same_l), np.zeros_like(same_h)
    first_l = first_h = None
    before, here = index(-1), index(0)
    for k in range(shorter + 1):
        after = index(k + 1)
        if k == end:
            first_l, first_h = same_l, same_h
        own = base[high] + letters[high, k]
        deleted = (deleted & before[own]) | same_h
        same_h = same_h & here[own]
        if k < shorter:
            own = base[low] + letters[low, k]
            here_l = here[own]
            inserted = (inserted | same_l) & after[own]
            replaced = (replaced & here_l) | (same_l & ~here_l)
            same_l = same_l & here_l
        before, here = here, after
    near[low] = (replaced & short[bucket[low]]) | ((inserted | same_l) & long[bucket[low]])
    near[high] = deleted & short[bucket[high]]
    if end < shorter:
        near[low] &= ~first_l
        near[high] &= ~first_h
    return near


def _answers(words: pa.Array, counts: np.ndarray, key: np.ndarray, shorter: int, end: int) -> Iterator[pa.RecordBatch]:
    """Near words of whole buckets of one (l, e); slots go by falling count, so the lowest bit is the best."""
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(new, len(key)))
    width = -(-sizes // 64)
    data = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8)
    length = np.asarray(pa.compute.utf8_length(words)).astype(np.int64)
    begin = np.cumsum(length) - length
    order = np.argsort(np.where(sizes > 1, width, 0), kind="stable")
    order = order[np.searchsorted(sizes[order] > 1, True):]  # a word alone has nobody near
    cells = np.cumsum(sizes[order] * width[order])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(cells, (cells[i - 1] if i else 0) + _CELLS, "right")))
        j = i + max(1, int(np.searchsorted(width[order[i:j]], width[order[i]], "right")))  # of one width
        chosen = order[i:j]
        i = j
        size = sizes[chosen]
        bucket = np.repeat(np.arange(len(chosen)), size)
        slot = np.arange(len(bucket)) - np.repeat(np.cumsum(size) - size, size)
        row = np.repeat(new[chosen], size) + slot
        lengths = length[row]
        at = begin[row][:, None] + np.minimum(np.arange(shorter + 1), lengths[:, None] - 1)
        kinds = np.zeros(256, np.int64)
        kinds[data[at]] = 1
        letters = (np.cumsum(kinds) - 1)[data[at]]
        near = near_words(letters, lengths, bucket, slot, shorter, end)
        n_near = np.bitwise_count(near).sum(axis=1, dtype=np.int64)
        found = np.flatnonzero(n_near)
        if not len(found):
            continue
        hit = near[found]
        first = np.argmax(hit != 0, axis=1)
        least = hit[np.arange(len(found)), first]
        best = new[chosen][bucket[found]] + first * 64 + np.bitwise_count((least & (~least + _U(1))) - _U(1)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([words.take(pa.array(row[found])), pa.array(n_near[found]), words.take(pa.array(best)), pa.array(counts[best])], ["word", "near", "best", "best_n"])


def _search(batches: Iterator[pa.RecordBatch], hold: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Buckets come sorted; whole ones are answered as soon as enough rows are held."""
    import pyarrow.compute  # noqa: F401

    held: list[pa.RecordBatch] = []

    def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        shorter, end, key = (table.column(c).to_numpy() for c in ("l", "e", "key"))
        cuts = np.flatnonzero((shorter[1:] != shorter[:-1]) | (end[1:] != end[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(key)]):
            part = table.slice(a, b - a)
            words, counts = part.column("word").combine_chunks(), part.column("n").to_numpy()
            # long words: fewer rows at a time, still whole buckets
            step = max(1, (1 << 23) // (int(shorter[a]) + 1))
            edge = np.append(np.flatnonzero(np.append(True, key[a + 1:b] != key[a:b - 1])), b - a)
            lo = 0
            while lo < b - a:
                hi = int(edge[max(np.searchsorted(edge, lo, "right"), np.searchsorted(edge, lo + step, "right") - 1)])
                yield from _answers(words.slice(lo, hi - lo), counts[lo:hi], key[a + lo:a + hi], int(shorter[a]), int(end[a]))
                lo = hi

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= hold:
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            last = np.flatnonzero(key != key[-1])
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield from answer(table.slice(0, whole))
                held = table.slice(whole).to_batches()
    if held and sum(b.num_rows for b in held):
        yield from answer(pa.Table.from_batches(held))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of words with a form. A form counts many times more often, so chains
    are short and without circles; each round doubles the steps taken."""
    hop = stage(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = hop.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if hop.join(on, "root", "left_semi").isEmpty():
            return hop
        hop = stage(hop.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, every: int = 31, min_length: int = 7, min_count: int = 2, factor: int = 10, bucket_size: int = 1024,
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are maximal runs of ``A-Za-zÀ-ÿ`` with A-Z lower-cased; of a run whose
    crc32 of ``<id>:<run>`` is a multiple of ``every`` the code point at checksum modulo length
    goes first (0: of none). Words of at least ``min_length`` code points that occur at least ``min_count``
    times count. ``n_near`` is the number of words one error away; ``form`` the
    one of them with the largest n (of equals the first in code-point order), if that is at least
    ``factor`` times the word's; ``root`` where following forms ends.

    Null and empty texts have no words; a null id is read as an empty one; rows that repeat
    count each; an empty table gives an empty result; other columns are not read.
    ``min_length`` is at least 2 and ``factor`` above 1. Buckets over ``bucket_size`` words are split, never cut.
    """
    if min_length < 2 or factor <= 1:
        raise ValueError("min_length is at least 2 and factor above 1")
    words = stage(vocabulary(docs, id_col, text_col, every, min_length, min_count), "spelling-words")
    entries = buckets(words, min_length, bucket_size).select("word", "n", "l", "e", "key")
    dealt = entries.repartition("key").sortWithinPartitions("l", "e", "key", F.desc("n"), "word")
    pairs = dealt.mapInArrow(_search, "word string, near long, best string, best_n long")
    found = pairs.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    rows = words.join(found, "word", "left").withColumn("formed", -F.col("top.less") >= factor * F.col("n"))
    rows = stage(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr("CASE WHEN formed THEN top.best END").alias("form"),
        F.expr("CASE WHEN formed THEN -top.less END").alias("form_n")), "spelling-forms")
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
