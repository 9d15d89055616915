"""What op1 and op3 stand on: how rows are dealt, what the automaton decides, what the suffix arrays confirm."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsight.llm import arrays as A, recurring, substring, suffixes


@pytest.mark.parametrize("row_id", ["null", "7"])
def test_equal_rows_spread_over_blocks(spark, row_id):
    """Rows with null or equal ids and equal texts fill no block."""
    docs = spark.range(4000).select(F.expr(f"cast({row_id} as long)").alias("doc_id"), F.lit("the same text " * 20).alias("text")).repartition(3)
    dealt = recurring.documents(docs, "doc_id", "text", "test", block_bytes=28_000)
    sizes = {r.block: r.n for r in dealt.groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 4000 and len(sizes) == 40
    assert max(sizes.values()) < 2 * 4000 / 40
    assert sizes == {r.block: r.n for r in dealt.groupBy("block").agg(F.count("*").alias("n")).collect()}


def test_blocks_follow_bytes_not_rows(spark):
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x y "), 1000).alias("text"))
    few = recurring.documents(docs, "doc_id", "text", "test")
    many = recurring.documents(docs, "doc_id", "text", "test", block_bytes=4000)
    assert few.agg(F.max("block")).first()[0] < 8 <= many.agg(F.max("block")).first()[0] < 64
    assert recurring.documents(docs.limit(0), "doc_id", "text", "test").count() == 0


@pytest.mark.parametrize("letters", [1, 2, 5, 1000])
def test_passages_around_matches_are_the_stretches(letters):
    """Looked at from each place by itself, the passages are those of the whole text, ties included."""
    r = np.random.default_rng(letters)
    rows = np.sort(r.integers(0, 9, 700))
    units = A.mix(r.integers(1, letters + 1, 700).astype(np.uint64))
    whole = recurring.Stretches(units, rows, 35, 8)
    near = recurring.Around(whole.rolling, rows, np.arange(700 - 7), 35, 8)
    place = lambda s: sorted(zip(s.at.tolist(), s.first.tolist(), s.last.tolist(), s.anchor.tolist(), s.name.tolist()))
    assert place(near) == place(whole) and len(near.at)


def test_parts_cut_windows_and_agree_on_what_they_share():
    r = np.random.default_rng(3)
    units = r.integers(97, 123, 3000).astype(np.uint8)
    rows = np.repeat([0, 1], 1500)
    whole, cut = (recurring.Stretches(units, rows, 400, 32, parts) for parts in (1, 2))
    windows = lambda s: sorted(w for a, b in zip(s.first.tolist(), s.last.tolist()) for w in range(a, b + 1))
    assert windows(whole) == windows(cut) == [w for w in range(2601) if rows[w] == rows[w + 399]]
    # a copy of a window elsewhere has the same key
    twice = np.concatenate([units[:1000], units[300:900], units[:50]])
    s = recurring.Stretches(twice, np.zeros(len(twice), int), 400, 32, 2)
    key = {w: k for a, b, k in zip(s.first.tolist(), s.last.tolist(), s.anchor.tolist()) for w in range(a, b + 1)}
    assert all(key[300 + k] == key[1000 + k] for k in range(201))


def _removed(text, phrases, passages):
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "data": pa.array([], pa.binary())})
    rows = lambda **c: pa.table({k: c.get(k, pa.nulls(len(next(iter(c.values()))), empty.schema.field(k).type)) for k in empty.schema.names})
    facts = {substring._PASSAGE: rows(a=pa.array(A.signed(passages.anchor)), b=pa.array(A.signed(passages.name))), substring._PHRASE: rows(text=pa.array(phrases, pa.string()))}
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])
    return [b.column(2).to_pylist()[0] for b in substring._remove(35, 8)(0, facts)(batch)][0]


def test_the_automaton_decides():
    """A passage whose phrase the automaton lacks stays, though its hashes are known."""
    text = " ".join(f"w{k}" for k in range(35)) + " between " + " ".join(f"v{k}" for k in range(35))
    raw = np.frombuffer(text.encode(), np.uint8)
    s, hashes = substring._word_stretches(raw, np.array([0, len(raw)]), 35, 8)
    letters = substring._symbols(hashes)
    phrases = [letters[2 * p:2 * (p + 8)] for p in s.at.tolist()]
    assert len(s.at) > 1
    assert _removed(text, phrases, s) == 71
    covered = lambda some: len({w for k in some for w in range(s.first[k], s.last[k] + 35)})
    for gone in range(len(s.at)):
        left = [k for k in range(len(s.at)) if phrases[k] != phrases[gone]]
        assert _removed(text, [phrases[k] for k in left], s) == covered(left)
    assert _removed(text, [], s) == 0
    # a phrase alone confirms nothing
    s.name = s.name + np.uint64(1)
    assert _removed(text, phrases, s) == 0


def test_suffix_arrays_confirm_what_hashes_call_equal():
    """Two copies that only share their names, not their bytes, remove nothing."""
    def ranges(first, second):
        table = pa.table({"shard": pa.array([0, 0], pa.int32()), "i": pa.array([0, 0], pa.int32()), "j": pa.array([0, 0], pa.int32()), "anchor": pa.array([5, 5]), "name": pa.array([6, 6]),
                          "home": pa.array([0, 0], pa.int32()), "n": pa.array([2, 2]), "copy": pa.array([suffixes._FIRST, suffixes._SECOND], pa.int32()), "data": pa.array([first, second], pa.binary())})
        return [np.frombuffer(d, "<i4").tolist() for d in suffixes._search(40)(table).column("data").to_pylist()]

    r = np.random.default_rng(1)
    text, other = (r.integers(97, 123, 60).astype(np.uint8).tobytes() for _ in range(2))
    assert ranges(text, text) == [[0, 60]]
    assert ranges(text, other) == []
    assert ranges(text, text[:45] + other[45:]) == [[0, 45]]
