"""Suffix-array dedup of bytes.

Stretches of text that recur in part are the candidates: those that share
the bytes all their windows have in common. Of a stretch that occurs once a copy goes to a
shard, of one that recurs two copies from different places, so that nothing is removed which a suffix
array has not found twice. Each shard sorts its suffixes by Larsson-Sadakane refinement as far as a
window reaches, and marks the windows that have an equal neighbour. Where the stretches of one bucket need several shards, every two of them
are merged by binary search of one's windows in the other's suffix array.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsight.llm import arrays as A
from logsight.llm.recurring import Stretches, among, by_block, documents, join_name, known, longs, partitions_of, recurring
from logsight.session import stage

WINDOW, GRAM = 400, 32
#: Parts of a window that the anchor's place is told apart by.
PARTS = 2
_PART = 0
_FIRST, _SECOND = 1, 2
PIECE_BYTES = 1 << 20
SHARD_BYTES = 4 << 20
#: Ends a stretch in a shard's text; no byte of UTF-8.
_STOP = 0xFF


def packed(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k:k + len(text)]
    return out


def _ranked(keys: np.ndarray, positions: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in the order of their keys, the rank of each of the ``n`` of the text (the place of the
    first of its group, from 1; past the end and of positions not asked for 0), and the places in groups of two or more."""
    order = np.argsort(keys)
    ordered = keys[order]
    order = positions[order].astype(np.int32)
    place = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(place, len(order)))
    rank = np.zeros(n + 1, np.int32)
    rank[order] = np.repeat(place, size) + 1
    return order, rank, np.flatnonzero(np.repeat(size, size) > 1)


def _thrice(n: int) -> bool:
    """Whether the ranks one and two prefixes on and a group of a text of ``n`` fit one key."""
    return 3 * n.bit_length() <= 65  # there are half as many groups as members, at most


def _split(order: np.ndarray, rank: np.ndarray, tied: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """Splits the groups that the places ``tied`` of ``order`` hold by the ranks ``steps`` on (one or
    two), in place. Returns the places that still tie."""
    n = len(rank) - 1
    bits = n.bit_length()
    at = order[tied]
    group = rank[at]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(at)))
    after = rank[np.minimum(at + np.int32(steps[0]), n)].astype(np.uint64)
    for step in steps[1:]:
        after = (after << np.uint64(bits)) | rank[np.minimum(at + np.int32(step), n)].astype(np.uint64)
    # a group of two needs no sort: its members are put in order by one comparison
    two = first[size == 2]
    x, y = after[two], after[two + 1]
    swap, apart = two[x > y], two[x != y]
    at[swap], at[swap + 1] = at[swap + 1], at[swap]
    new_rank = group.copy()
    new_rank[apart + 1] += 1
    still = np.zeros(len(at), bool)
    same = two[x == y]
    still[same] = still[same + 1] = True
    rest = np.flatnonzero(np.repeat(size, size) > 2)
    if len(rest):
        groups = np.repeat(np.arange(len(first), dtype=np.uint64), size)[rest]
        key = (groups << np.uint64(bits * len(steps))) | after[rest]
        by = np.argsort(key)
        key = key[by]
        at[rest] = at[rest[by]]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(head, len(rest)))
        new_rank[rest] = np.repeat(tied[rest[head]], size) + 1
        still[rest] = np.repeat(size, size) > 1
    order[tied] = at
    rank[at] = new_rank
    return tied[still]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order: sorted by eight bytes, then groups that still tie are
    split by the rank of the suffix that starts where the known prefix ends (and of the next one), so that
    the prefix doubles or triples each time, until none is left."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    order, rank, tied = _ranked(packed(text), np.arange(n), n)
    step, thrice = 8, _thrice(n)
    while len(tied):
        tied = _split(order, rank, tied, (step, 2 * step) if thrice else (step,))
        step *= 2 + thrice
    return order.astype(np.int64)


def repeated_windows(text: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Those of the windows that start at ``at`` which equal another one: the suffix array of ``at``, its
    refinement ended when the known prefix is the window. A suffix that is no longer needed (no window reads its
    rank at the next prefix) is not refined, so a round has fewer suffixes than the one before."""
    n = len(text)
    if not len(at):
        return at
    known, rounds = min(8, window), []
    while known < window:
        to = min(known * (2 + _thrice(n)), window)
        rounds.append((known, to - known) if to > 2 * known else (to - known,))
        known = to
    needed = [np.zeros(n, bool)]
    needed[0][at] = True
    for steps in reversed(rounds):
        before = needed[-1].copy()
        for step in steps:
            before[step:] |= needed[-1][:-step]
        needed.append(before)
    start = np.flatnonzero(needed.pop())
    order, rank, tied = _ranked(packed(text)[start] >> np.uint64(8 * max(0, 8 - window)), start, n)
    for steps in rounds:
        tied = tied[needed.pop()[order[tied]]]
        if len(tied):
            tied = _split(order, rank, tied, steps)
    return order[tied].astype(np.int64)


def _extend(keys: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of positions a and b, known to be ``length`` at least, up to ``most``."""
    n = len(keys)
    todo = np.flatnonzero(length < most)
    while len(todo):
        x, y = a[todo] + length[todo], b[todo] + length[todo]
        inside = (x < n) & (y < n)
        todo, x, y = todo[inside], x[inside], y[inside]
        differ = keys[x] ^ keys[y]
        same = np.where(differ == 0, 8, 0)
        if len(todo):
            some = differ != 0
            # leading equal bytes: the exponent of a number is exact enough for its highest byte
            high = np.zeros(int(some.sum()), np.int64)
            rest = differ[some]
            for shift in (32, 16, 8):
                big = rest >= (np.uint64(1) << np.uint64(shift))
                high += np.where(big, shift // 8, 0)
                rest = np.where(big, rest >> np.uint64(shift), rest)
            same[some] = 7 - high
            room = n - np.maximum(x, y)
            length[todo] += np.minimum(same, room)
        todo = todo[(same == 8) & (length[todo] < most)]
    return np.minimum(length, most)


def joined(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text with a stop after each stretch, start of each stretch)."""
    size = np.array([len(s) + 1 for s in stretches], np.int64)
    return np.frombuffer(b"".join(s + b"\xff" for s in stretches), np.uint8), np.cumsum(size) - size


def _window_starts(starts: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    many = np.maximum(sizes - window + 1, 0)
    return np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())


def repeated_within(stretches: list[bytes], window: int) -> np.ndarray:
    """Flags the positions of the joined text whose window occurs twice in the shard."""
    text, starts = joined(stretches)
    flags = np.zeros(len(text), bool)
    flags[repeated_windows(text, _window_starts(starts, np.array([len(s) for s in stretches], np.int64), window), window)] = True
    return flags


def repeated_across(left: list[bytes], right: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags the windows of either shard that occur in the other: each window of
    the left one is looked up in the right one's suffix array by binary search."""
    a, a_starts = joined(left)
    b, b_starts = joined(right)
    query = _window_starts(a_starts, np.array([len(s) for s in left], np.int64), window)
    order = suffix_array(b)
    both = np.concatenate([a, b])
    keys, shift = packed(both), len(a)

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(query), np.int64), np.full(len(query), len(order), np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            x, y = query[open_], order[mid] + shift
            n = _extend(keys, x, y, np.zeros(len(x), np.int64), window)
            end = y + n >= len(both)
            less = np.where(n >= window, upper, end | (both[np.minimum(y + n, len(both) - 1)] < both[np.minimum(x + n, len(a) - 1)]))
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        return low

    low, high = bound(False), bound(True)
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    in_a[query[high > low]] = True
    edge = np.zeros(len(order) + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    in_b[order[np.cumsum(edge)[:-1] > 0]] = True
    return in_a, in_b


def _ranges(flags: np.ndarray, window: int) -> bytes:
    """Byte ranges that flagged windows cover, as little-endian pairs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return np.stack([edge[0::2], edge[1::2] + window - 1], axis=1).astype("<i4").tobytes()


def _byte_stretches(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Iterator[tuple[Stretches, int]]:
    """Stretches of a run of texts, and the row offset of its bytes. A long
    text comes in pieces that overlap by a window less one byte, so each window is in one piece."""
    if len(data) <= 2 * PIECE_BYTES:
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        yield Stretches(data, rows, window, gram, PARTS), 0
        return
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(a, b, PIECE_BYTES):
            part = data[at:min(at + PIECE_BYTES + window - 1, b)]
            yield Stretches(part, np.full(len(part), row), window, gram, PARTS), at


def _texts_of(window: int, gram: int):
    """Facts: stretches of which the block gives the first copy, the second one
    or both. Rows: each copy with its bytes."""

    def use(block: int, facts: dict[int, pa.Table]):
        look = facts.get(_PART)
        names = join_name(longs(look, "a"), longs(look, "b"))
        order = np.argsort(names)
        names = names[order]
        due = np.frombuffer(b"".join(look.column("data").to_pylist()), np.uint8)[order] if look is not None else np.zeros(0, np.uint8)

        def do(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, _, data, offsets in A.texts(batch, "text"):
                for s, base in _byte_stretches(data, offsets, window, gram):
                    mine = join_name(s.anchor, s.name)
                    at = np.flatnonzero(among(mine, names))
                    k = np.searchsorted(names, mine[at])
                    for copy in (_FIRST, _SECOND):
                        open_ = np.flatnonzero(due[k] & copy)
                        _, first = np.unique(k[open_], return_index=True)
                        take = open_[first]
                        due[k[take]] -= copy
                        given = at[take]
                        at, k = np.delete(at, take), np.delete(k, take)
                        texts = [data[base + a:base + b].tobytes() for a, b in zip(s.first[given].tolist(), (s.last[given] + window).tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(A.signed(s.anchor[given])), pa.array(A.signed(s.name[given])), pa.array(np.full(len(given), copy, np.int32)), pa.array(texts, pa.binary())],
                            ["anchor", "name", "copy", "data"])
        return do
    return use


def _remove(window: int, gram: int):
    """Facts: covered ranges of stretches. Rows: one per document."""

    def use(block: int, facts: dict[int, pa.Table]):
        names = join_name(longs(facts.get(_PART), "a"), longs(facts.get(_PART), "b"))
        order = np.argsort(names)
        names = names[order]
        ranges = facts[_PART].column("data").take(pa.array(order)).to_pylist() if _PART in facts else []
        pairs = np.frombuffer(b"".join(ranges), "<i4").reshape(-1, 2)
        upto = np.concatenate([[0], np.cumsum([len(r) // 8 for r in ranges], dtype=np.int64)])

        def do(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo, hi, data, offsets in A.texts(batch, "text"):
                edge = np.zeros(len(data) + 1, np.int32)
                for s, base in _byte_stretches(data, offsets, window, gram):
                    mine = join_name(s.anchor, s.name)
                    some = np.flatnonzero(among(mine, names))
                    a, b = upto[np.searchsorted(names, mine[some])], upto[np.searchsorted(names, mine[some], "right")]
                    size = b - a
                    at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                    start = np.repeat(base + s.first[some], size)
                    np.add.at(edge, start + pairs[at, 0], 1)
                    np.add.at(edge, start + pairs[at, 1], -1)
                gone = np.cumsum(edge)[:-1] > 0
                out = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    flags = gone[a:b]
                    removed = int(flags.sum())
                    kept = data[a:b][~flags].tobytes() if removed else data[a:b].tobytes()
                    spans = int(np.count_nonzero(flags[1:] & ~flags[:-1])) + int(bool(len(flags) and flags[0])) if removed else 0
                    out.append((b - a, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
                n, removed, spans, digest, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(removed), pa.array(spans), pa.array(digest), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        return do
    return use


def _search(window: int):
    def work(table: pa.Table) -> pa.Table:
        out = pa.schema([("home", pa.int32()), ("n", pa.int64()), ("anchor", pa.int64()), ("name", pa.int64()), ("data", pa.binary())])
        if not table.num_rows:
            return out.empty_table()
        table = table.sort_by([("shard", "ascending"), ("anchor", "ascending"), ("name", "ascending"), ("copy", "ascending")])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        texts = table.column("data").to_pylist()
        if i == j:
            flags = repeated_within(texts, window)
        else:
            cut = int((table.column("shard").to_numpy() == i).sum())
            flags = np.concatenate(repeated_across(texts[:cut], texts[cut:], window))
        ends = np.cumsum([len(t) + 1 for t in texts])
        first = np.flatnonzero(table.column("copy").to_numpy() == _FIRST)
        found = [(k, _ranges(flags[ends[k] - len(texts[k]) - 1:ends[k] - 1], window)) for k in first.tolist()]
        found = [(k, r) for k, r in found if r]
        rows = table.take(pa.array([k for k, _ in found], pa.int64()))
        return pa.table([rows.column("home"), rows.column("n"), rows.column("anchor"), rows.column("name"), pa.array([r for _, r in found], pa.binary())], schema=out)
    return work


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, kept (the bytes left). A byte goes if a string of ``window`` bytes over it starts
    anywhere else too, in the same document or another; strings never cross documents and are
    judged on the input.

    Null texts are empty; short texts lose nothing; rows that repeat an id are
    documents of their own, and repeat each other's strings; an empty table gives an empty
    result; other columns are not read. A bucket holds a quarter of ``shard_bytes`` on
    average, which sorts in a processor's cache; one that has more than ``shard_bytes`` is split, and its shards merged two by two.
    """
    docs = documents(docs, id_col, text_col, "bytes")
    places, kinds = recurring(docs, lambda data, offsets: (s for s, _ in _byte_stretches(data, offsets, window, gram)), "bytes")
    open_ = kinds.filter("mixed or n > 1")
    both = (F.col("n") > 1) & (F.col("home") == F.col("other"))
    copies = [known(open_.withColumn("data", F.unhex(F.when(both, "03").otherwise("01"))), _PART, "home", a="anchor", b="name", data="data"),
              known(open_.filter("home <> other").withColumn("data", F.unhex(F.lit("02"))), _PART, "other", a="anchor", b="name", data="data")]
    texts = stage(by_block(docs, copies, _texts_of(window, gram), "anchor long, name long, copy int, data binary"), "copies")
    total = texts.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(1, -(-4 * total // shard_bytes))
    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets))
    # the few buckets over a shard: a table as small as its file, so Spark sees whether it can be broadcast
    large = stage(texts.groupBy(bucket.alias("bucket")).agg(F.ceil(F.sum(F.length("data")) / shard_bytes).cast("int").alias("shards")).filter("shards > 1"), "large-buckets")
    texts = texts.join(open_.select("anchor", "name", "home", "n"), ["anchor", "name"]).withColumn("bucket", bucket)
    texts = texts.join(large, "bucket", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("name"), F.col("shards")).cast("int"))
    # a shard alone, and the first copies with those of each other shard of its bucket
    other = F.explode(F.when(F.col("copy") == _FIRST, F.sequence(F.lit(0), F.col("shards") - 1)).otherwise(F.array("shard")))
    pairs = texts.withColumn("other", other).select(
        "bucket", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"), "shard", "anchor", "name", "home", "n", "copy", "data")
    # each merge is dealt by itself: no grouping rides on a join's partitioning by bucket
    dealt = pairs.repartition(partitions_of(docs), "bucket", "i", "j")
    part = stage(dealt.groupBy("bucket", "i", "j").applyInArrow(_search(window), "home int, n long, anchor long, name long, data binary"), "covered")
    again = part.filter("n > 1").select("anchor", "name", "data").join(places.select("anchor", "name", "block"), ["anchor", "name"])
    facts = [known(part.filter("n = 1"), _PART, "home", a="anchor", b="name", data="data"), known(again, _PART, a="anchor", b="name", data="data")]
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return by_block(docs, facts, _remove(window, gram), schema).withColumnRenamed("id", id_col)
