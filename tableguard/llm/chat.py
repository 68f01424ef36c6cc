"""Chat formatting: whole conversations as bytes in one Arrow buffer, with loss spans.

Format of a turn: ``### role: text</turn>`` and a line feed. The characters backslash, ``<`` and
``#`` are written ``\\b``, ``\\l`` and ``\\h`` inside roles and texts (``:`` as ``\\c`` in roles), so
no control string can occur there and reading back is exact.

Rows are dealt by conversation and sorted by turn inside the tasks, which stream over them: a
conversation that is larger than ``PART_BYTES`` comes out in several parts, so no task holds one
whole. Lengths, cumulative offsets and scatter positions are computed in numpy, and headers,
contents and endings are copied into one preallocated buffer per part.

Null roles and texts are empty; rows without conversation id form one conversation; equal turns
are ordered by role, then text; repeated rows are repeated turns; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tableguard.llm.batches import column_bytes, id_type, map_arrow, arrow_schema, ranges, starts_of

HEAD, MIDDLE, END = b"### ", b": ", b"</turn>\n"
ESCAPES = {ord("\\"): ord("b"), ord("<"): ord("l"), ord("#"): ord("h")}
ROLE_ESCAPES = ESCAPES | {ord(":"): ord("c")}
LEARNED = "assistant"
#: Bytes of rows of one conversation that a task holds before it gives out a part.
PART_BYTES = 8 << 20


def _letters(escapes: dict[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[list(escapes)] = list(escapes.values())
    return table


_TEXT, _ROLE = _letters(ESCAPES), _letters(ROLE_ESCAPES)


def _escaped(data: np.ndarray, at: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Escaped lengths of the rows, positions of the bytes inside their rows, letters of escapes."""
    letter = letters[data]
    before = starts_of((letter > 0).astype(np.int64))
    lengths = np.diff(at) + before[at[1:]] - before[at[:-1]]
    inside = np.arange(len(data), dtype=np.int64) + before[:-1] - np.repeat(at[:-1] + before[at[:-1]], np.diff(at))
    return lengths, inside, letter


def _scatter(out: np.ndarray, starts: np.ndarray, data: np.ndarray, at: np.ndarray, inside: np.ndarray, letter: np.ndarray) -> None:
    to = np.repeat(starts, np.diff(at)) + inside
    special = letter > 0
    out[to] = np.where(special, np.uint8(ord("\\")), data)
    out[to[special] + 1] = letter[special]


def _constant(out: np.ndarray, starts: np.ndarray, value: bytes) -> None:
    for k, byte in enumerate(value):
        out[starts + k] = byte


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of the turns, their offsets, and start and end of each text."""
    role, role_at = column_bytes(roles)
    text, text_at = column_bytes(texts)
    role_len, role_in, role_letter = _escaped(role, role_at, _ROLE)
    text_len, text_in, text_letter = _escaped(text, text_at, _TEXT)
    at = starts_of(len(HEAD) + role_len + len(MIDDLE) + text_len + len(END))
    out = np.empty(at[-1], dtype=np.uint8)
    role_start = at[:-1] + len(HEAD)
    text_start = role_start + role_len + len(MIDDLE)
    _constant(out, at[:-1], HEAD)
    _scatter(out, role_start, role, role_at, role_in, role_letter)
    _constant(out, role_start + role_len, MIDDLE)
    _scatter(out, text_start, text, text_at, text_in, text_letter)
    _constant(out, text_start + text_len, END)
    return out, at, text_start, text_start + text_len


def format_schema(turns: DataFrame, id_col: str) -> T.StructType:
    spans = T.ArrayType(T.LongType())
    return T.StructType([
        T.StructField(id_col, id_type(turns, id_col)), T.StructField("part", T.LongType()), T.StructField("last", T.BooleanType()),
        T.StructField("formatted", T.StringType()), T.StructField("loss_starts", spans), T.StructField("loss_ends", spans),
    ])


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation (or part of a very large one): id, part, last, formatted, loss spans.

    Loss spans are byte positions of the assistants' texts in ``formatted``.
    """
    narrow = turns.select(turns[id_col].alias("_id"), turns[turn_col].alias("_turn"), F.coalesce(turns[role_col], F.lit("")).alias("_role"), F.coalesce(turns[text_col], F.lit("")).alias("_text"))
    dealt = narrow.repartition(F.col("_id")).sortWithinPartitions("_id", "_turn", "_role", "_text")
    schema = format_schema(turns, id_col)
    return map_arrow(dealt, lambda batches: _formatted(batches, arrow_schema(schema)), schema)


def _formatted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Format runs of rows; the run at the end of a batch waits for the next batch."""
    held: pa.Table | None = None
    part = 0  # of the conversation that the held rows belong to
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            if (a := held["_id"][-1].as_py()) != (b := table["_id"][0].as_py()) or (a is None) != (b is None):
                yield _rows(held, part, True, schema)
                part = 0
            else:
                table = pa.concat_tables([held, table])
        table = table.combine_chunks()
        cut = _last_run(table["_id"])
        if cut:
            yield _rows(table.slice(0, cut), part, True, schema)
            part, table = 0, table.slice(cut)
        held = table
        if held.nbytes > PART_BYTES and held.num_rows > 1:  # one row stays, to carry the end
            yield _rows(held.slice(0, held.num_rows - 1), part, False, schema)
            part, held = part + 1, held.slice(held.num_rows - 1)
    if held is not None:
        yield _rows(held, part, True, schema)


def _runs(ids: pa.ChunkedArray) -> np.ndarray:
    """Starts of the runs of equal ids (null equals null)."""
    codes = pa.concat_arrays(ids.chunks).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def _last_run(ids: pa.ChunkedArray) -> int:
    return int(_runs(ids)[-1])


def _rows(table: pa.Table, part: int, last: bool, schema: pa.Schema) -> pa.RecordBatch:
    """One output row per run; ``part`` counts for the first run, ``last`` for the last."""
    runs = _runs(table["_id"])
    roles = pa.concat_arrays(table["_role"].chunks)
    data, at, starts, ends = assemble(roles, pa.concat_arrays(table["_text"].chunks))
    bounds = at[np.append(runs, table.num_rows)]
    learned = np.array([r == LEARNED for r in roles.to_pylist()])
    owner = np.searchsorted(runs, np.arange(table.num_rows), side="right") - 1
    spans = starts_of(np.bincount(owner[learned], minlength=len(runs)))
    base = bounds[:-1][owner[learned]]
    formatted = pa.LargeStringArray.from_buffers(len(runs), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pa.array(values - base, pa.int64()))

    parts = np.zeros(len(runs), np.int64)
    parts[0] = part
    ends_here = np.ones(len(runs), bool)
    ends_here[-1] = last
    columns = [table["_id"].combine_chunks().take(pa.array(runs)), pa.array(parts), pa.array(ends_here), formatted, lists(starts[learned]), lists(ends[learned])]
    columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def unescape(data: bytes) -> bytes:
    return data.replace(b"\\l", b"<").replace(b"\\h", b"#").replace(b"\\c", b":").replace(b"\\b", b"\\")


def read_turns(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Roles and texts of formatted bytes."""
    at = 0
    while at < len(formatted):
        end = formatted.index(END, at)
        role, text = formatted[at + len(HEAD) : end].split(MIDDLE, 1)
        yield unescape(role), unescape(text)
        at = end + len(END)


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of the conversations, from the output of ``format_chats`` as it was dealt."""
    schema = T.StructType([
        T.StructField(id_col, id_type(formatted, id_col)), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                data = row["formatted"].encode()
                for role, text in read_turns(data):
                    turns.update(role + b"\n" + text + b"\n")
                    counts[0] += 1
                for start, end in zip(row["loss_starts"], row["loss_ends"], strict=True):
                    text = unescape(data[start:end])
                    loss.update(text)
                    counts[1] += len(text.decode())
                counts[2] += len(row["formatted"])
                if row["last"]:
                    out.append((row[id_col], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))
                    turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return map_arrow(formatted, run, schema)
