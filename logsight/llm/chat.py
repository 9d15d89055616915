"""Chat formatting by columnar byte assembly.

Turns become ``<|im_start|>role\\ntext<|im_end|>\\n``. Lengths of all segments
give cumulative offsets, and the bytes of headers and contents are scattered
into one preallocated buffer that is the output column's own data.

Inside texts and roles a backslash goes before every backslash and between
``<`` and ``|``, and a line break in a role is written ``\\n``: no control string can
come from a text, and the way back is unambiguous.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from logsight.llm import arrays as A

START, END = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n((?:(?!<\|).)*)<\|im_end\|>\n", re.S)
_UNSAFE = re.compile(r"\\|(?<=<)\|")
_SAFE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str, role: bool = False) -> str:
    return _SAFE.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text) if "\\" in text else text


def _ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each element, its place in the row) for rows of these lengths."""
    ends = np.cumsum(lengths)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, row starts in it, content starts, content ends) of formatted turns."""
    coded = pc.fill_null(roles, "").dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    heads = [f"{START}{escape(r.as_py()).replace(chr(10), chr(92) + 'n')}\n".encode() for r in coded.dictionary]
    head_bytes = np.frombuffer(b"".join(heads), np.uint8)
    head_size = np.array([len(h) for h in heads], np.int64)
    head_at = np.cumsum(head_size) - head_size

    data, offsets = A.byte_column(texts)
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    size = np.diff(offsets)
    marked = data == 0x5C
    bar = np.flatnonzero(data == 0x7C)
    bar = bar[bar > 0]
    bar = bar[(data[bar - 1] == 0x3C) & ~np.isin(bar, offsets)]
    marked[bar] = True
    extra = np.concatenate([[0], np.cumsum(marked)])
    before = extra[offsets[:-1]]
    text_size = size + extra[offsets[1:]] - before

    foot = np.frombuffer(END.encode(), np.uint8)
    row_size = head_size[code] + text_size + len(foot)
    row_end = np.cumsum(row_size)
    row_at = row_end - row_size
    text_at = row_at + head_size[code]
    text_end = text_at + text_size

    out = np.empty(int(row_end[-1]) if len(row_end) else 0, np.uint8)
    rows, place = _ragged(head_size[code])
    out[row_at[rows] + place] = head_bytes[head_at[code][rows] + place]
    rows, place = _ragged(size)
    to = text_at[rows] + place + extra[1:len(data) + 1] - before[rows]
    out[to] = data
    out[to[marked] - 1] = 0x5C
    out[(text_end[:, None] + np.arange(len(foot))).ravel()] = np.tile(foot, len(text_end))
    return out, np.append(row_at, row_end[-1:]), text_at, text_end


def _format(ids: pa.Array, roles: pa.Array, texts: pa.Array, bounds: np.ndarray, learn: str) -> Iterator[pa.RecordBatch]:
    """Formats whole conversations; ``bounds`` are their first rows and the end."""
    _, offsets = A.byte_column(texts)
    for lo, hi in A.row_groups(offsets[bounds]):
        a, b = int(bounds[lo]), int(bounds[hi])
        out, row_at, text_at, text_end = assemble(roles.slice(a, b - a), texts.slice(a, b - a))
        first = bounds[lo:hi + 1] - a
        starts = row_at[first]
        points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
        taught = np.flatnonzero(pc.fill_null(pc.equal(roles.slice(a, b - a), learn), False).to_numpy(zero_copy_only=False))
        owner = np.searchsorted(first, taught, "right") - 1
        base = points[starts[owner]]
        at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=hi - lo))]), pa.int32())
        text = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(bounds[lo:hi])), pa.array(np.diff(first)), text,
             pa.ListArray.from_arrays(at, pa.array(points[text_at[taught]] - base)), pa.ListArray.from_arrays(at, pa.array(points[text_end[taught]] - base))],
            ["id", "n_turns", "formatted", "loss_start", "loss_end"])


def format_chat(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, ``n_turns``, ``formatted``, and the loss
    mask as code-point ranges ``loss_start``/``loss_end``, one per turn of ``learn_role``.

    Turns go by ``turn``, ties by role and text; repeated rows are turns of
    their own. Null texts and roles are empty; a null id is a conversation of
    its own; an empty table gives an empty result; other columns are not read.
    One shuffle by conversation; a conversation becomes one string, so its
    turns meet in one task, and only the conversation at the end of a batch is held over.
    """
    rows = conversations.select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = lambda b, i: b.column(0)[i].as_py()
            if held and key(held[0], 0) == key(batch, 0) == key(batch, batch.num_rows - 1):
                held.append(batch)
                continue
            yield from emit(held + [batch], False)
            ids = batch.column(0)
            same = pc.is_null(ids) if not ids[-1].is_valid else pc.fill_null(pc.equal(ids, ids[-1]), False)
            first = batch.num_rows - pc.sum(same).as_py()  # sorted: the last id's rows are at the end
            held = [batch.slice(first)]
        yield from emit(held, True)

    def emit(parts: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, roles, texts = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns)
        if not len(ids):
            return
        plain, null = pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False)
        new = np.flatnonzero((plain[1:] != plain[:-1]) | (null[1:] != null[:-1])) + 1
        bounds = np.concatenate([[0], new, [len(ids)]])
        if not last:
            bounds = bounds[:-1]
        if len(bounds) > 1:
            yield from _format(ids, roles, texts, bounds, learn_role)

    schema = "id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, end = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            raise ValueError("not a formatted conversation")
        end = m.end()
        out.append((unescape(m[1], role=True), unescape(m[2])))
    if end != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what the formatted rows hold: turns, and the text under the loss mask."""
    source = formatted.select(F.col(id_col).alias("id"), "formatted", "loss_start", "loss_end")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = []
            for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                turns = parse(text)
                all_turns = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends))
                rows.append((len(turns), all_turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    schema = "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return source.mapInArrow(work, schema).withColumnRenamed("id", id_col)
