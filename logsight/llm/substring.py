"""Substring dedup with repeated-phrase automata.

Passages that recur are confirmed first: candidate stretches by their
anchors, then the windows of stretches that differ. The anchor phrases of a block's
confirmed passages are compiled into that block's Aho-Corasick automaton, an
automaton shard, and all documents of the block stream through it. Its matches are the only places
looked at: of each, the passage around it is hashed, and where that or a window of it is
confirmed its words are removed.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsight.llm import arrays as A
from logsight.llm.recurring import Around, Stretches, among, by_block, documents, join_name, known, longs, recurring
from logsight.session import stage

WINDOW, GRAM = 35, 8
_PASSAGE, _WINDOW, _PHRASE = 0, 1, 2


def _word_stretches(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[Stretches, np.ndarray]:
    starts, ends, rows = A.runs(data, offsets, A.WORD_BYTES)
    hashes = A.hash_runs(data, starts, ends)
    return Stretches(hashes, rows, window, gram), hashes


#: Characters of a word, and the values of each: a small alphabet, as an
#: automaton's node searches its edges in turn.
_LETTERS, _VALUES = 2, 32


def _symbols(hashes: np.ndarray) -> str:
    """Two letters for each word; different words may share them. First and
    second letters differ, so that no match starts inside a word."""
    low = np.empty((len(hashes), _LETTERS), np.uint8)
    for k in range(_LETTERS):
        low[:, k] = ((hashes >> np.uint64(5 * k)) & np.uint64(_VALUES - 1)).astype(np.uint8) + _VALUES * (k + 1)
    return low.tobytes().decode("ascii")


def _confirm(window: int, gram: int):
    """Facts: passages to look at and anchors that recur. Rows: the anchors'
    phrases, and the hash of each window of the passages."""

    def use(block: int, facts: dict[int, pa.Table]):
        look = facts.get(_PASSAGE)
        names = join_name(longs(look, "a"), longs(look, "b"))
        order = np.argsort(names)
        names = names[order]
        names_out = ["block", "anchor", "phrase", "window", "n"]
        count = np.zeros(0, np.uint8)
        if look is not None:
            count = np.frombuffer(b"".join(look.column("data").to_pylist()), np.uint8)[order]
        once = np.sort(longs(facts.get(_PHRASE), "a"))
        done = np.zeros(len(names), bool)
        told = np.zeros(len(once), bool)

        def do(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for _, _, data, offsets in A.texts(batch, "text"):
                s, hashes = _word_stretches(data, offsets, window, gram)
                new = np.flatnonzero(among(s.anchor, once))
                _, first = np.unique(s.anchor[new], return_index=True)
                new = new[first]
                k = np.searchsorted(once, s.anchor[new])
                new, k = new[~told[k]], k[~told[k]]
                told[k] = True
                text = _symbols(hashes) if len(new) else ""
                phrases = [text[_LETTERS * p:_LETTERS * (p + gram)] for p in s.at[new].tolist()]
                home = lambda n: pa.array(np.full(n, block, np.int32))
                yield pa.RecordBatch.from_arrays([home(len(new)), pa.array(A.signed(s.anchor[new])), pa.array(phrases, pa.string()), pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.int32())], names_out)
                mine = join_name(s.anchor, s.name)
                at = np.flatnonzero(among(mine, names))
                _, first = np.unique(mine[at], return_index=True)
                at = at[first]
                k = np.searchsorted(names, mine[at])
                at, k = at[~done[k]], k[~done[k]]
                done[k] = True
                size = s.last[at] - s.first[at] + 1
                starts = np.repeat(s.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
                hashed = s.rolling.spans(starts, starts + window)
                n = np.repeat(count[k], size).astype(np.int32)
                owner = np.repeat(A.signed(s.anchor[at]), size)
                yield pa.RecordBatch.from_arrays([home(len(starts)), pa.array(owner), pa.nulls(len(starts), pa.string()), pa.array(A.signed(hashed)), pa.array(n)], names_out)
        return do
    return use


def _remove(window: int, gram: int):
    """Facts: confirmed passages, confirmed windows and phrases of a block. Rows: one per document."""

    def use(block: int, facts: dict[int, pa.Table]):
        import ahocorasick

        passages = np.sort(join_name(longs(facts.get(_PASSAGE), "a"), longs(facts.get(_PASSAGE), "b")))
        windows = np.sort(join_name(longs(facts.get(_WINDOW), "a"), longs(facts.get(_WINDOW), "b")))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase in (facts[_PHRASE].column("text").to_pylist() if _PHRASE in facts else ()):
            automaton.add_word(phrase, 1)
        automaton.make_automaton()

        def cover(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            starts, ends, rows = A.runs(data, offsets, A.WORD_BYTES)
            hashes = A.hash_runs(data, starts, ends)
            edge = np.zeros(len(hashes) + 1, np.int64)
            if len(automaton) and len(hashes) >= window:
                found = np.fromiter((end for end, _ in automaton.iter(_symbols(hashes))), np.int64)
                rolling = A.Rolling(hashes)
                s = Around(rolling, rows, (found + 1) // _LETTERS - gram, window, gram)
                sure = among(join_name(s.anchor, s.name), passages)
                np.add.at(edge, s.first[sure], 1)
                np.add.at(edge, s.last[sure] + window, -1)
                part = np.flatnonzero(~sure)
                size = s.last[part] - s.first[part] + 1
                at = np.repeat(s.first[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
                at = at[among(join_name(np.repeat(s.anchor[part], size), rolling.spans(at, at + window)), windows)]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
            return np.cumsum(edge)[:-1] == 0

        def do(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for lo, hi, data, offsets in A.texts(batch, "text"):
                keep = cover(data, offsets)
                whole, out, at = data.tobytes(), [], 0
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    words = whole[a:b].split()
                    mine = keep[at:at + len(words)]
                    at += len(words)
                    removed = len(words) - int(mine.sum())
                    kept = b" ".join(compress(words, mine.tolist()) if removed else words)
                    out.append((len(words), removed, hashlib.sha256(kept).hexdigest(), kept))
                n, removed, digest, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(removed), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_sha256", "kept"])
        return do
    return use


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256, kept (the words
    left, joined by single spaces). A word goes if a window of ``window`` words over it occurs
    anywhere else, in the same document too; windows are judged on the input.

    Null, empty and short texts have no windows and lose nothing; rows that
    repeat an id are documents of their own, and repeat each other's windows;
    an empty table gives an empty result; other columns are not read. Words are compared by 64-bit
    hashes of the whole window and of its anchor, whose phrase the automaton has found.
    """
    docs = documents(docs, id_col, text_col, "words")
    places, kinds = recurring(docs, lambda data, offsets: iter([_word_stretches(data, offsets, window, gram)[0]]), "words")
    # windows of stretches that share an anchor and differ: equal windows may be in both
    capped = kinds.filter("mixed").withColumn("data", F.unhex(F.when(F.col("n") > 1, "02").otherwise("01")))
    anchors = places.select("block", "anchor").distinct()
    facts = [known(capped, _PASSAGE, "home", a="anchor", b="name", data="data"), known(anchors, _PHRASE, a="anchor")]
    told = stage(by_block(docs, facts, _confirm(window, gram), "block int, anchor long, phrase string, window long, n int"), "confirm")
    windows = told.filter("window is not null")
    twice = stage(windows.groupBy("anchor", "window").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", "window"), "repeated-windows")
    alone = stage(windows.filter("n = 1").join(twice, ["anchor", "window"], "left_semi").select("block", "anchor", "window"), "alone")
    sure = stage(places.join(kinds.filter("n > 1").select("anchor", "name"), ["anchor", "name"], "left_semi").select("block", "anchor", "name"), "sure")
    confirmed = sure.select("block", "anchor").unionByName(alone.select("block", "anchor")).distinct()
    phrases = told.filter("phrase is not null").select("block", "anchor", "phrase").join(confirmed, ["block", "anchor"], "left_semi")
    facts = [known(sure, _PASSAGE, a="anchor", b="name"), known(alone, _WINDOW, a="anchor", b="window"), known(phrases, _PHRASE, a="anchor", text="phrase")]
    schema = "id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return by_block(docs, facts, _remove(window, gram), schema).withColumnRenamed("id", id_col)
