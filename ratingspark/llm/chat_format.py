r"""Chat formatting: conversations as marked text with a loss mask, assembled column by column.

A template puts an opening and a closing string around each turn. Control strings inside
texts are escaped: between the first character of a control string and its rest goes one
backslash more than there is (none is the control string itself), so unescaping takes one away
and every text can be read back.

1. Rows are range-partitioned by (conversation, turn) and sorted, so a conversation with a
   great share of all rows is dealt over many tasks. No row needs another task's rows: a turn
   is formatted by itself, and a conversation is the concatenation of its turns.
2. A task works through slices of some MB. Of a slice it knows the segments in output order: opening,
   pieces of text between escapes, backslashes, closing. Segment lengths give cumulative
   offsets, offsets give the index of the source byte for each output byte, and one gather
   fills a preallocated Arrow buffer. No Python string is made of a text.
3. A conversation is one row (``part`` 0) unless it is longer than a slice or crosses a
   boundary between tasks; then its further parts follow in order of ``part``. Parts that may
   go on elsewhere are marked ``open``: the last of each slice and the first of a task.
4. Reading back parses the formatted text and cuts the loss text out by the mask. Closed parts are read
   where they lie; open ones are brought together by conversation and streamed part by part.

Turns are ordered by turn (null first), role and text. A null text is empty, a null role has the name "".
Roles without markers of their own are written by name. Rows of a null conversation form one
conversation. Repeated rows are turns of their own. Tables without rows give none. Only the
four named columns are read, so further columns may have any name. Lengths are in code points; bytes that are no UTF-8
are passed on as they are. A text has to fit a task, as its row does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import store

#: Bytes of text that are assembled at once.
SLICE = 4_000_000
#: Bytes that a row counts besides its text.
ROW = 32
PARTS = "conv_id long, part long, open boolean, n_turns long, formatted string, loss array<struct<start:int,stop:int>>"


@dataclass(frozen=True)
class Template:
    """Markers by role, how other roles are named, and the role that is learned.

    All markers are control strings with blanks at the inner side; a control string starts with ``[`` or ``<``
    and holds neither further on.
    """

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANSWER] ", " </s>")})
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
    learned: str = "assistant"

    @property
    def controls(self) -> list[bytes]:
        return sorted({m.strip().encode() for pair in (*self.roles.values(), self.other) for m in pair})

    def pattern(self, slashes: bytes) -> re.Pattern:
        """Control strings with so many backslashes behind their first character."""
        return re.compile(b"|".join(re.escape(c[:1]) + slashes + re.escape(c[1:]) for c in self.controls))


def escape(template: Template, text: bytes) -> bytes:
    return template.pattern(rb"\\*").sub(lambda m: m[0][:1] + b"\\" + m[0][1:], text)


def unescape(template: Template, text: bytes) -> bytes:
    return template.pattern(rb"\\+").sub(lambda m: m[0][:1] + m[0][2:], text)


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    column = pa.concat_arrays([pa.compute.fill_null(column.cast(pa.binary()), b"")])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def _code_points(body: np.ndarray) -> np.ndarray:
    """Number of code points before each byte, and of all."""
    return np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])


def assemble(template: Template, roles: pa.Array, texts: pa.Array, starts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Formatted strings and loss spans of the conversations whose first turns are ``starts``."""
    n = len(texts)
    names = roles.dictionary_encode()
    markers = []
    for name in names.dictionary.to_pylist():
        begin, end = template.roles.get(name, (None, None))
        markers += [template.other[0].encode() + escape(template, name.encode()) + template.other[1].encode(), template.other[2].encode()] \
            if begin is None else [begin.encode(), end.encode()]
    body, at = _strings(texts)
    pool = np.concatenate([body, np.frombuffer(b"\\" + b"".join(markers), np.uint8)])
    slash = len(body)
    sizes = np.array([len(m) for m in markers], np.int64)
    marker_at = slash + 1 + np.concatenate([[0], np.cumsum(sizes)])[:-1]
    kind = names.indices.to_numpy()

    # Where a backslash goes in; a match that runs into the next text is none.
    found = np.array([(m.start(), m.end()) for m in template.pattern(rb"\\*").finditer(body)], np.int64).reshape(-1, 2)
    owner = np.searchsorted(at, found[:, 0], "right") - 1
    inside = found[:, 1] <= at[owner + 1]
    cuts, owner = found[inside, 0] + 1, owner[inside]

    # Segments in output order: opening, piece, (backslash, piece)*, closing.
    escapes = np.bincount(owner, minlength=n)
    counts = 3 + 2 * escapes
    first = np.concatenate([[0], np.cumsum(counts)])
    source, length = np.full(first[-1], slash, np.int64), np.ones(first[-1], np.int64)
    source[first[:-1]], length[first[:-1]] = marker_at[2 * kind], sizes[2 * kind]
    source[first[1:] - 1], length[first[1:] - 1] = marker_at[2 * kind + 1], sizes[2 * kind + 1]
    rank = np.arange(len(cuts)) - np.concatenate([[0], np.cumsum(escapes)])[owner]
    piece_at = np.sort(np.concatenate([first[:-1] + 1, first[owner] + 3 + 2 * rank]))
    piece_start = np.sort(np.concatenate([at[:-1], cuts]), kind="stable")
    text_of = np.repeat(np.arange(n), 1 + escapes)
    last = np.concatenate([text_of[1:] != text_of[:-1], [True]])
    piece_stop = np.where(last, at[text_of + 1], np.concatenate([piece_start[1:], [0]]))
    source[piece_at], length[piece_at] = piece_start, piece_stop - piece_start

    offsets = np.concatenate([[0], np.cumsum(length)])
    total = int(offsets[-1])
    index = np.arange(total, dtype=np.int32 if total + len(pool) < 1 << 31 else np.int64)
    index += np.repeat((source - offsets[:-1]).astype(index.dtype), length)
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    np.take(pool, index, out=out, mode="clip")

    begins = offsets[first[starts]]
    bounds = pa.py_buffer(np.append(begins, total).astype(np.int32))
    formatted = pa.StringArray.from_buffers(len(starts), bounds, buffer)
    learned = np.flatnonzero(kind == (names.dictionary.index(template.learned).as_py()))
    conversation = np.searchsorted(starts, learned, "right") - 1
    points = _code_points(out)
    base = points[begins[conversation]]
    spans = pa.StructArray.from_arrays([
        pa.array((points[offsets[first[learned] + 1]] - base).astype(np.int32)),
        pa.array((points[offsets[first[learned + 1] - 1]] - base).astype(np.int32))], names=["start", "stop"])
    lists = np.concatenate([[0], np.cumsum(np.bincount(conversation, minlength=len(starts)))]).astype(np.int32)
    return formatted, pa.ListArray.from_arrays(pa.array(lists), spans)


def _changes(ids: pa.Array) -> np.ndarray:
    """Positions of rows whose conversation is not that of the row before, with 0."""
    value, null = pa.compute.fill_null(ids, 0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])]))


def _slices(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in slices of about ``limit`` bytes that end with a conversation, if that is not longer than a slice."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        begin = 0
        for stop in _cuts(lengths + ROW, limit, size):
            held.append(batch.slice(begin, stop - begin))
            whole = pa.concat_batches(held)
            split = int(_changes(whole.column("conv_id"))[-1])
            split = split if split else whole.num_rows
            yield whole.slice(0, split)
            held = [whole.slice(split)] if split < whole.num_rows else []
            begin = stop
        held.append(batch.slice(begin))
        size = sum(h.column("text").nbytes + ROW * h.num_rows for h in held)
    if held and (whole := pa.concat_batches(held)).num_rows:
        yield whole


def _cuts(lengths: np.ndarray, limit: int, held: int) -> list[int]:
    """Row counts after which ``limit`` bytes are full."""
    cuts, size = [], held
    for row, length in enumerate(lengths.tolist(), 1):
        size += length
        if size >= limit:
            cuts.append(row)
            size = 0
    return cuts


def _format(template: Template, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = TaskContext.get().partitionId() << 40, ()
        for piece in _slices(batches, limit):
            starts = _changes(piece.column("conv_id"))
            roles = pa.compute.fill_null(piece.column("role"), "")
            formatted, loss = assemble(template, roles, piece.column("text"), starts)
            turns = np.diff(np.append(starts, piece.num_rows))
            ids = piece.column("conv_id").take(pa.array(starts))
            # A part may go on: the first from the task or slice before, the last in the next one.
            edge = np.zeros(len(starts), bool)
            edge[0] = last in ((), (ids[0].as_py(),))
            edge[-1] = True
            last = (ids[-1].as_py(),)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(number + np.arange(len(starts))), pa.array(edge), pa.array(turns), formatted, loss],
                names=["conv_id", "part", "open", "n_turns", "formatted", "loss"])
            number += len(starts)

    return run


def format_conversations(turns: DataFrame, template: Template | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as formatted parts with their loss spans (code points within the part)."""
    width = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    dealt = rows.repartitionByRange(width, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(template or Template(), slice_bytes), PARTS)


def parse(template: Template, formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted part."""
    opening = {begin.encode(): (role.encode(), end.encode()) for role, (begin, end) in template.roles.items()}
    named, text, close = (m.encode() for m in template.other)
    pattern, at = template.pattern(b""), 0
    while at < len(formatted):
        mark = pattern.match(formatted, at)
        begin = mark[0] + b" " if mark else b""
        if begin in opening:
            role, end = opening[begin]
            start = at + len(begin)
        elif begin == named:
            stop = formatted.index(text, at + len(named))
            role, end, start = unescape(template, formatted[at + len(named):stop]), close, stop + len(text)
        else:
            raise ValueError(f"no turn begins at byte {at}")
        stop = formatted.index(end, start)
        yield role, unescape(template, formatted[start:stop])
        at = stop + len(end)


def _read(template: Template):
    """Streams parts ordered by (conversation, part) into one row for each conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state = None
        for batch in batches:
            loss = batch.column("loss")
            for row, conv in enumerate(batch.column("conv_id").to_pylist()):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(_finish(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = pa.compute.cast(batch.column("formatted").slice(row, 1), pa.binary())[0].as_py()
                for role, text in parse(template, formatted):
                    state[1] += 1
                    state[2].update(role + b"\n" + text + b"\n")
                body = np.frombuffer(formatted, np.uint8)
                byte_of = np.append(np.flatnonzero((body & 0xC0) != 0x80), len(body))
                for span in loss[row].as_py():
                    text = unescape(template, formatted[byte_of[span["start"]]:byte_of[span["stop"]]])
                    state[3] += int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())
                    state[4].update(text)
                state[5] += len(byte_of) - 1
            if len(done) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                done = []
        if state is not None:
            done.append(_finish(state))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    return run


def _finish(state: list) -> tuple:
    conv, turns, all_turns, loss_chars, loss, chars = state
    return conv, turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def read_back(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation what its formatted parts hold: turns, their digest, the text under the loss mask, lengths."""
    template = template or Template()
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ["conv_id", "part", "formatted", "loss"]
    width = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crossing = parts.filter("open").select(*columns).repartition(width, "conv_id").sortWithinPartitions("conv_id", "part")
    return parts.filter("not open").select(*columns).mapInArrow(_read(template), schema).unionByName(
        crossing.mapInArrow(_read(template), schema))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(store(format_conversations(turns.unionByName(planted))))


OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\[\\*(?:/?INST|/?SYS|/?ROLE|TEXT|ANSWER)\]|<\\*/s>')) +
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 14
      ELSE 23 + length(role) + len(regexp_extract_all(role, '\[\\*(?:/?INST|/?SYS|/?ROLE|TEXT|ANSWER)\]|<\\*/s>')) END AS size
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
