"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

One pass tokenises every document and cuts it into pieces; the pieces are
dealt to shards of bounded size; in a shard every piece goes where the sum of
the squared counts of open sequences per residual gap becomes smallest.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logsight.session import stage

CAPACITY = 2048
SHARD_PIECES = 1 << 15
_CHUNK = 1 << 20
#: Letters and digits among the characters of the quick path (lower case).
_L, _N = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
_PARTS = re.compile(rf"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_L}{_N}]+")
#: Anything else goes through the library whole: case, white space or composition may differ.
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\\u012f\\u0131-\\u017f\\u2010-\\u2027]")
_BLANK = re.compile(r"[ \t\n\r]")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Parts(dict):
    """Token ids of text parts, as little-endian 32-bit bytes; forgets when full."""

    def __init__(self, model, most: int = 400_000):
        self.model, self.letters, self.most = model, _byte_letters(), most

    def __missing__(self, part: str) -> bytes:
        letters = part.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        if len(self) >= self.most:
            self.clear()
        if len(part) <= 64:
            self[part] = ids
        return ids


class Encoder:
    """Ids of the word vocabulary. Texts of Latin letters are cut into the
    vocabulary's parts here, and the library's model encodes each distinct
    part once; any other text goes through the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = _Parts(self.tokenizer.model)

    def chunk(self, text: str) -> bytes:
        if _OTHER.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))

    def ids(self, text: str) -> Iterator[bytes]:
        """Ids in turn, for stretches between blanks of about a megabyte."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > _CHUNK and (blank := _BLANK.search(text, at + _CHUNK)):
                end = blank.start()
            yield self.chunk(text[at:end])
            at = end


def pieces(encoder: Encoder, text: str, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids and the closing 0."""
    held, piece, size = bytearray(), 0, 4 * capacity
    for part in (*encoder.ids(text), b"\0\0\0\0") if len(text) <= _CHUNK else _closed(encoder.ids(text)):
        held += part
        while len(held) >= size:
            yield piece, piece * capacity, capacity, zlib.crc32(held[:size])
            del held[:size]
            piece += 1
    if held:
        yield piece, piece * capacity, len(held) // 4, zlib.crc32(held)


def _closed(parts: Iterator[bytes]) -> Iterator[bytes]:
    yield from parts
    yield b"\0\0\0\0"


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str | None, capacity: int) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path is None:
            import public_tokenizers
        encoder = Encoder(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"))
        names = ["id", "piece", "start", "length", "ids_crc32"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        rows: list[tuple] = []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k, text in enumerate(batch.column(1)):
                for piece in pieces(encoder, text.as_py(), capacity):
                    rows.append((ids[k], *piece))
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return source.mapInArrow(work, "id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int, place: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """Packs in the given order: (sequences, sequence of each, offset of each).

    counts[g] is the number of open sequences with gap g. Moving one from gap
    g to g - s changes the sum of squares by 2 (counts[g - s] - counts[g]) + 2;
    filling it, or opening a new one, leaves out the term that is not counted."""
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)] if place else []
    where, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            where[i] = made
            made += 1
            continue
        here, after = counts[s:], counts[:capacity + 1 - s]
        change = 2 * (after - here) + 2
        change[0] = 1 - 2 * here[0]
        change[here == 0] = 1 << 60
        change[-1] = 2 * after[-1] + 1  # a new sequence, from the full gap
        left = int(change.argmin())  # of equals the tightest fit
        gap = left + s
        if gap == capacity:
            at, made = made, made + 1
        else:
            counts[gap] -= 1
            at = open_at[gap].pop() if place else 0
        if left:
            counts[left] += 1
            if place:
                open_at[left].append(at)
        where[i], offset[i] = at, capacity - gap
    return made, where, offset


def pack_shard(lengths: np.ndarray, capacity: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Sum-of-squares packing in the best of four orders: by length, and as
    dealt with the pieces under a bound last and by length."""
    place = np.arange(len(lengths))
    by_length = np.argsort(-lengths, kind="stable")
    orders = [by_length]
    for bound in (capacity // 32, capacity // 16, capacity // 8):
        orders.append(np.concatenate([place[lengths >= bound], by_length[lengths[by_length] < bound]]))
    best = min(range(len(orders)), key=lambda k: (sum_of_squares(lengths[orders[k]], capacity, place=False)[0], k))
    made, where, offset = sum_of_squares(lengths[orders[best]], capacity)
    out_where, out_offset = np.empty_like(where), np.empty_like(offset)
    out_where[orders[best]], out_offset[orders[best]] = where, offset
    return made, out_where, out_offset


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents over ``capacity`` are cut. Pieces go to
    ceil(pieces / ``shard_pieces``) shards by a hash of their number in the written
    pieces, so a shard is a bounded, even share whatever the documents and however often one comes; a
    shard this large packs to within a few parts in a thousand of the least
    possible. Null and empty texts are the closing id alone; a null id stays
    null; rows that repeat an id are documents of their own; an empty table
    gives an empty result; other columns are not read.
    """
    cut = stage(token_pieces(docs, id_col, text_col, tokenizer_path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("spread", "ascending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        _, where, offset = pack_shard(lengths, capacity)
        shard = table.column("shard")[0].as_py() if table.num_rows else 0
        return table.drop_columns(["shard", "spread", "row"]).append_column("sequence_id", pa.array((shard << 32) + where)).append_column("offset", pa.array(offset))

    spread = F.xxhash64("row")
    dealt = cut.withColumn("spread", spread).withColumn("shard", F.pmod("spread", F.lit(shards)).cast("long"))
    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(work, schema).withColumnRenamed("id", id_col)
