"""SimHash near-duplicates by a vantage-point tree over the fingerprints.

A tree of vantage points, fitted to a bounded sample, deals all distinct
fingerprints to leaves by Hamming distance. A fingerprint near a boundary also
visits the leaves that the triangle bound cannot rule out. Each leaf searches
its own vantage-point tree for exact pairs and keeps one component per linked
set; components that share fingerprints across leaves are merged by least label.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsight.session import stage

SEED = 42


def fingerprint(text: str, width: int = 3) -> int:
    """64 bits, each set if set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    end = (start + size)[width - 1:].tolist()
    start = start[:len(end)].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(end), 1 << 16):
        parts = map(joined.__getitem__, map(slice, start[k:k + (1 << 16)], end[k:k + (1 << 16)]))
        hashes = np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(end[k:k + (1 << 16)]))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(end), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or "", width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    return source.mapInArrow(work, "id long, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def _vantage(points: np.ndarray, tries: int = 8) -> tuple[np.uint64, int]:
    """A vantage point and a cut of the distances to it: of some spread-out
    points the one, and of the cuts that halve the points fairly the one, with the fewest
    points within reach of the boundary."""
    best = None
    for v in points[np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int)]:
        count = np.bincount(_distance(points, v), minlength=70)
        below = np.cumsum(count)
        for cut in range(64):
            if 0.25 <= below[cut] / len(points) <= 0.75:
                near = int(count[max(0, cut - 1):cut + 3].sum()) + abs(2 * int(below[cut]) - len(points)) // 4
                if best is None or near < best[0]:
                    best = (near, v, cut)
        if best is None:  # most points are at one distance: halve as well as it goes
            cut = int(np.argmin(np.abs(below - len(points) / 2)[:64]))
            if 0 < below[cut] < len(points):
                best = (len(points), v, cut)
    return (best[1], best[2]) if best else (points[0], -1)


def grow(points: np.ndarray, leaf: int) -> list[tuple[int, int, int]]:
    """Tree nodes (vantage, cut, outer child); the inner child is the next
    node; a leaf has cut -1 and its number in place of the child."""
    nodes: list = []
    leaves = 0

    def add(points: np.ndarray) -> None:
        nonlocal leaves
        at = len(nodes)
        nodes.append(None)
        v, cut = _vantage(points) if len(points) > leaf else (np.uint64(0), -1)
        inner = _distance(points, v) <= cut
        if cut < 0 or inner.all() or not inner.any():
            nodes[at] = (0, -1, leaves)
            leaves += 1
            return
        add(points[inner])
        outer = len(nodes)
        add(points[~inner])
        nodes[at] = (int(v), cut, outer)

    add(points)
    return nodes


def route(nodes: list[tuple[int, int, int]], points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, points, resident flags). Each point resides in one leaf. Of two
    points within reach on either side of a cut the outer one visits the inner side."""
    todo = [(0, points, np.ones(len(points), bool))]
    while todo:
        at, p, own = todo.pop()
        v, cut, child = nodes[at]
        if not len(p):
            continue
        if cut < 0:
            yield child, p, own
            continue
        d = _distance(p, np.uint64(v))
        inner = np.where(own, d <= cut, d - reach <= cut)
        guest = own & (d > cut) & (d - reach <= cut)
        outer = np.where(own, d > cut, d + reach > cut)
        todo.append((at + 1, np.concatenate([p[inner], p[guest]]), np.concatenate([own[inner], np.zeros(int(guest.sum()), bool)])))
        todo.append((child, p[outer], own[outer]))


def near_pairs(queries: np.ndarray, points: np.ndarray, reach: int, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, point) within reach, by a vantage-point tree over the points."""
    todo = [(np.arange(len(queries)), np.arange(len(points)))]
    while todo:
        q, p = todo.pop()
        if not len(q) or not len(p):
            continue
        if len(p) > 32:
            v, cut = _vantage(points[p], 2)
            if cut >= 0:
                dp, dq = _distance(points[p], v), _distance(queries[q], v)
                if (dp <= cut).any() and (dp > cut).any():
                    todo += [(q[dq - reach <= cut], p[dp <= cut]), (q[dq + reach > cut], p[dp > cut])]
                    continue
        step = max(1, block // len(p))
        for k in range(0, len(q), step):
            a, b = np.nonzero(_distance(queries[q[k:k + step], None], points[p][None, :]) <= reach)
            if len(a):
                yield q[k:k + step][a], p[b]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def linked(points: np.ndarray, own: np.ndarray, reach: int) -> np.ndarray:
    """Component of each point (the index of one member): residents against all."""
    parent = np.arange(len(points))
    home = np.flatnonzero(own)
    for a, b in near_pairs(points, points[own], reach):
        b = home[b]
        while True:
            parent = _roots(parent)
            x, y = parent[a], parent[b]
            apart = x != y
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
    return _roots(parent)


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle_words: int = 3, max_bits: int = 2, leaf_size: int = 2048, sample: int = 20_000,
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``
    (the smallest id reachable over links of at most ``max_bits`` differing bits).

    Vantage points are fitted to the ``sample`` distinct fingerprints with the
    lowest hashes (the documented bound); every distinct fingerprint is then
    indexed. Equal fingerprints are one point, so groups of exact copies cost nothing.

    Null and empty texts have fingerprint zero and link like any other; rows
    that repeat an id keep a row each; a null id is never a component's least
    id unless all are null; an empty table gives an empty result; other columns are not read.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    points = stage(prints.groupBy("fp").agg(F.min("id").alias("least")), "points")
    total = points.count()
    some = np.array([r.fp for r in points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    nodes = grow(some, max(8, leaf_size * len(some) // max(total, 1))) if len(some) else [(0, -1, 0)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, p, own in route(nodes, batch.column(0).to_numpy().view(np.uint64), max_bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), leaf, np.int64)), pa.array(p.view(np.int64)), pa.array(own)], ["leaf", "fp", "own"])

    def search(table: pa.Table) -> pa.Table:
        # residents first and by value: the result does not depend on the order of arrival
        table = table.sort_by([("own", "descending"), ("fp", "ascending")])
        p, own = table.column("fp").to_numpy().view(np.uint64), table.column("own").to_numpy()
        root = linked(p, own, max_bits)
        many = np.bincount(root, minlength=len(p))[root] > 1
        leaf = table.column("leaf").to_numpy()
        return pa.table({"leaf": leaf[many], "root": root[many], "fp": p[many].view(np.int64)}).cast(pa.schema([("leaf", pa.int64()), ("root", pa.int64()), ("fp", pa.int64())]))

    dealt = points.select("fp").mapInArrow(deal, "leaf long, fp long, own boolean")
    members = stage(dealt.groupBy("leaf").applyInArrow(search, "leaf long, root long, fp long").withColumn("label", F.col("fp")), "members")
    while True:
        # a component's least label to its members, and a fingerprint's least to all its places
        within = members.join(members.groupBy("leaf", "root").agg(F.min("label").alias("low")), ["leaf", "root"])
        across = within.join(within.groupBy("fp").agg(F.min("low").alias("new")), "fp")
        step = stage(across.select("leaf", "root", "fp", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels")
        moved = step.filter("moved").limit(1).count()
        members = step.drop("moved")
        if not moved:
            break
    labels = points.join(members.groupBy("fp").agg(F.min("label").alias("label")), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labels = stage(labels, "point-labels")
    least = stage(labels.groupBy("label").agg(F.min("least").alias("component_id")), "components")
    by_print = stage(labels.select("fp", "label").join(least, "label").select("fp", "component_id"), "print-components")
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with the document of the least id of each component. Rows that repeat
    that id all stay; null ids stay if their component has no other."""
    found = simhash_components(docs, id_col, text_col, **limits)
    stay = found.filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id__")).distinct()
    return docs.join(stay, docs[id_col].cast("long").eqNullSafe(stay["__id__"]), "left_semi")
