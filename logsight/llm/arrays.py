"""Text columns as numpy arrays: byte views, words, rolling hashes.

Everything works on a run of rows of one Arrow batch. ``row_groups`` cuts a
batch into runs of a few megabytes, so that temporaries stay small however
many rows Spark puts into a batch; a longer single text makes a run of its own.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 2 << 20
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
#: Powers of the hash base and of its inverse modulo 2**64, by length.
_POWERS: dict[str, np.ndarray] = {}


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) if ends else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole, offsets


def row_groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def texts(batch: pa.RecordBatch, name: str, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of a batch."""
    data, offsets = byte_column(batch.column(batch.schema.get_field_index(name)))
    for lo, hi in row_groups(offsets, limit):
        part = offsets[lo:hi + 1]
        yield lo, hi, data[part[0]:part[-1]], part - part[0]


def table_of(*ranges: tuple[int, int], inside: bool = True) -> np.ndarray:
    """256 flags: the bytes in the ranges (both ends included), or all others."""
    flags = np.full(256, not inside)
    for first, last in ranges:
        flags[first:last + 1] = inside
    return flags


#: Bytes of words ``[^\x20\x09-\x0D]+``: UTF-8 continuation bytes are word bytes too.
WORD_BYTES = table_of((0x20, 0x20), (0x09, 0x0D), inside=False)
LINE_BYTES = table_of((0x0A, 0x0A), inside=False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of flagged bytes inside each row: starts, ends, rows."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    flags = table[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flags[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flags[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(flags & ~before)
    ends = np.flatnonzero(flags & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(n + 1, _CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * _powers(len(values))[0][:len(values)], out=out[1:])
    return out


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, mapped: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte run; equal runs hash alike anywhere. ``mapped``
    replaces bytes first (lower case). Works in pieces that fit the CPU's cache."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
        at, to = int(starts[i]), int(ends[j - 1])
        if to - at > _CHUNK:  # one run longer than a piece
            h = 0
            for k in range(at, to, _CHUNK):
                piece = data[k:min(k + _CHUNK, to)]
                piece = (mapped[piece] if mapped is not None else piece).astype(np.uint64) + _U(1)
                h += int(_prefix(piece)[-1]) * pow(_BASE, k - at, 1 << 64)
            out[i] = h & 0xFFFFFFFFFFFFFFFF
        else:
            piece = data[at:to]
            p = _prefix((mapped[piece] if mapped is not None else piece).astype(np.uint64) + _U(1))
            s = starts[i:j] - at
            out[i:j] = (p[ends[i:j] - at] - p[s]) * _powers(to - at)[1][s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


class Rolling:
    """Hashes of stretches of a value sequence (word hashes, bytes)."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.p = _prefix(values if values.dtype == np.uint64 else values.astype(np.uint64) + _U(1))

    def windows(self, k: int) -> np.ndarray:
        """Hash of every k consecutive values."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        m = self.n - k + 1
        return mix((self.p[k:] - self.p[:-k]) * _powers(self.n)[1][:m])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair; the length counts too."""
        raw = (self.p[ends] - self.p[starts]) * _powers(self.n)[1][starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in linear time."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = -(-n // width) * width
    grid = np.full(padded, np.iinfo(values.dtype).max, values.dtype)
    grid[:n] = values
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(grams: np.ndarray, width: int, whole: np.ndarray, position_bits: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined anchors: in each window of ``width`` consecutive grams
    the gram with the least hash, the leftmost of equals. Equal windows have
    the same anchor gram at the same place. ``whole`` lists the windows (by
    their first gram) that count. Returns the position of each anchor and the
    first and last window that it serves; a window has one anchor."""
    none = np.zeros(0, np.int64)
    n = len(grams)
    if n < width or not len(whole):
        return none, none, none
    position_bits = max(position_bits, int(n).bit_length())
    keep = _U((1 << position_bits) - 1)
    least = sliding_min((grams & ~keep) | np.arange(n, dtype=np.uint64), width)[whole]
    new = np.empty(len(least), bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    return (least[first] & keep).astype(np.int64), whole[first], whole[last]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
