"""Chat formatting by columnar byte assembly.

A turn becomes `<|role|>`, a line break, its text, `<|end|>` and a line break. A backslash is put
before each backslash of a text and before a bar that follows `<`, so that no text holds `<|`;
in roles it is put before each backslash and each bar. Reading back is one scan.
A batch of turns is laid out in numpy: lengths of the segments, their cumulative offsets, and
for each input byte the place that it is scattered to in one buffer, which Arrow then owns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import kernel as K
from cairn.llm.common import stored

_SLASH, _BAR, _LESS = 0x5C, 0x7C, 0x3C
_OPEN, _CLOSE, _END = b"<|", b"|>\n", b"<|end|>\n"
#: Bytes of formatted text in a row; a conversation beyond it goes on in the next row.
PART = 16 << 20

FORMATTED = "conv_id long, part int, formatted binary, loss_start array<long>, loss_end array<long>"
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.binary()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))])


def _escapes(data: np.ndarray, offsets: np.ndarray, all_bars: bool) -> np.ndarray:
    """Mask of the bytes that get a backslash before them."""
    bar = data == _BAR
    if not all_bars and len(data):
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == _LESS
        starts = offsets[:-1]
        after[starts[starts < len(data)]] = False
        bar &= after
    return bar | (data == _SLASH)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: bytes, offsets of the turns, and where each turn's text starts and ends."""
    n = len(roles)
    role, role_at = K.utf8(roles)
    text, text_at = K.utf8(texts)
    parts = []
    for data, at, bars in ((role, role_at, True), (text, text_at, False)):
        escaped = _escapes(data, at, bars)
        shift = np.cumsum(escaped)
        before = np.concatenate([[0], shift])[at]
        parts.append((data, at, escaped, shift, before, np.diff(at) + np.diff(before)))
    role_length, text_length = parts[0][5], parts[1][5]
    fixed = len(_OPEN) + len(_CLOSE) + len(_END)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(role_length + text_length + fixed, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint8)
    role_start = offsets[:-1] + len(_OPEN)
    text_start = role_start + role_length + len(_CLOSE)
    text_end = text_start + text_length
    for (data, at, escaped, shift, before, _), start in zip(parts, (role_start, text_start), strict=True):
        place = np.arange(len(data)) + shift + np.repeat(start - at[:-1] - before[:-1], np.diff(at))
        out[place] = data
        out[place[escaped] - 1] = _SLASH
    for mark, where in ((_OPEN, offsets[:-1]), (_CLOSE, text_start - len(_CLOSE)), (_END, text_end)):
        out[where[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    return out, offsets, text_start, text_end


def _format(batches: Iterator[pa.RecordBatch], loss_role: str) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        if not ids:
            continue
        out, offsets, start, end = assemble(batch.column("role"), batch.column("text"))
        learned = np.array([r == loss_role for r in batch.column("role").to_pylist()])
        rows, row = [], 0
        while row < len(ids):
            stop = row + 1
            while stop < len(ids) and ids[stop] == ids[row] and offsets[stop + 1] - offsets[row] <= PART:
                stop += 1
            part = part + 1 if ids[row] == last else 0
            last = ids[row]
            mine = np.arange(row, stop)[learned[row:stop]]
            rows.append((last, part, row, stop, start[mine] - offsets[row], end[mine] - offsets[row]))
            row = stop
        # The formatted column is a view of the one buffer.
        bounds = np.array([offsets[r[2]] for r in rows] + [offsets[-1]], np.int64)
        for a, b in K.pieces(bounds, 1 << 30):
            cuts = (bounds[a : b + 1] - bounds[a]).astype(np.int32)
            body = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts), pa.py_buffer(out[bounds[a] : bounds[b]])])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows[a:b]], pa.int64()), pa.array([r[1] for r in rows[a:b]], pa.int32()), body, pa.array([r[4] for r in rows[a:b]], pa.list_(pa.int64())), pa.array([r[5] for r in rows[a:b]], pa.list_(pa.int64()))],
                schema=_FORMATTED,
            )


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Formatted conversations from rows of conv_id, turn, role and text, in the rows of FORMATTED.

    Turns go by turn, then role and text, nulls first; a null role or text is empty, a null
    conv_id is one conversation. The rows of a conversation follow each other in one partition,
    by part; loss_start and loss_end are byte ranges of the part that are learned from.
    A task holds one batch of turns at a time, whatever the length of a conversation; how many
    turns that is says spark.sql.execution.arrow.maxRecordsPerBatch when the rows are written.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(lambda it: _format(it, loss_role), FORMATTED)


def unescape(x: bytes) -> bytes:
    return re.sub(rb"\\(.)", rb"\1", x, flags=re.S) if b"\\" in x else x


def parse(body: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Roles and texts of the turns in formatted bytes."""
    at = 0
    while at < len(body):
        if not body.startswith(_OPEN, at):
            raise ValueError("no turn starts here")
        close = body.index(_CLOSE, at + len(_OPEN))
        while (close - len(body[at:close].rstrip(b"\\")) - at) % 2:  # the bar is escaped
            close = body.index(_CLOSE, close + 1)
        end = body.index(_OPEN, close + len(_CLOSE))
        if not body.startswith(_END, end):
            raise ValueError("no turn ends here")
        yield unescape(body[at + len(_OPEN) : close]), unescape(body[close + len(_CLOSE) : end])
        at = end + len(_END)


def _chars(x: bytes) -> int:
    return len(x.decode())


class _Read:
    def __init__(self, conv_id) -> None:
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.sha, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, body: bytes, starts: list[int], ends: list[int]) -> None:
        self.chars += _chars(body)
        for role, text in parse(body):
            self.turns += 1
            self.sha.update(role + b"\n" + text + b"\n")
        for a, b in zip(starts, ends, strict=True):
            text = unescape(body[a:b])
            self.loss_chars += _chars(text)
            self.loss.update(text)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.sha.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in READ.split(", ")]
    now = None
    for batch in batches:
        done = []
        for conv_id, part, body, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or part == 0:
                done += [now.row()] if now else []
                now = _Read(conv_id)
            now.add(body, starts, ends)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), types, strict=True)], names)


def read_back(formatted: DataFrame, ordered: bool = True) -> DataFrame:
    """What the formatted rows say, a row for each conversation; ordered: they come straight from format_conversations()."""
    if not ordered:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.mapInArrow(_read, READ)


#: Conversation -7 of op7: both texts look like markup of other templates.
TRICKY = "\\### Assistant: </turn> ok"


def op7(conversations: DataFrame) -> DataFrame:
    """Stored: what the formatted conversations say, read back, a row for each conversation and -7.

    Null texts and roles are empty; a null conv_id is one conversation; turns of one number, and
    repeated rows, go by role and text and all count; an empty table gives conversation -7 alone.
    Columns beyond conv_id, turn, role and text are not read. A conversation -7 of the table
    takes the two added rows in.
    """
    spark = conversations.sparkSession
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(tricky)
    return stored(read_back(format_conversations(rows)), "conversations")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(13 + length(replace(replace(role, '\', '\\'), '|', '\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
