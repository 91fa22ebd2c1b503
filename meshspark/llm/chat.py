"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>`` and a line feed. Inside role and text, control strings are escaped: a backslash doubles,
``#`` becomes ``\\#`` and ``</turn>`` becomes ``<\\/turn>``; a colon in a role becomes ``\\:``. Taking the backslashes off again gives
the text back, and no text can hold a bare header or end mark.

Per batch, the lengths of all segments give offsets, the offsets give a place for every byte, and headers and contents are
scattered into one buffer that becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meshspark.llm.shared import buffer_of, partitions, query, read, sliced

OPEN, COLON, CLOSE = b"### ", b": ", b"</turn>\n"
PARTS = "conv_id {id}, part struct<turn:{turn},role:string,hash:bigint>, n_turns bigint, text string, loss array<struct<start:bigint,end:bigint>>"


def _needs_escape(data: np.ndarray, offsets: np.ndarray, role: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where a backslash goes before a byte, and where one goes behind it."""
    before = (data == 0x5C) | (data == 0x23)
    if role:
        before |= data == 0x3A
    behind = np.zeros(len(data), bool)
    end = np.frombuffer(b"</turn>", np.uint8)
    if len(data) >= len(end):
        at = np.flatnonzero(data[:len(data) - len(end) + 1] == end[0])
        for i, c in enumerate(end):
            at = at[data[at + i] == c]
        row_end = offsets[np.searchsorted(offsets, at, side="right")]
        behind[at[at + len(end) <= row_end]] = True
    return before, behind


def _escaped(column, role: bool) -> tuple[np.ndarray, np.ndarray]:
    """Escaped bytes of a column and the new row offsets."""
    data, offsets = buffer_of(column)
    before, behind = _needs_escape(data, offsets, role)
    width = 1 + before + behind
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    out = np.full(ends[-1], 0x5C, np.uint8)
    out[ends[:-1] + before] = data
    return out, ends[offsets]


def assemble(roles, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns in order: (bytes, turn offsets, start and end byte of each content)."""
    role, role_at = _escaped(roles, True)
    text, text_at = _escaped(texts, False)
    n = len(role_at) - 1
    fixed = len(OPEN) + len(COLON) + len(CLOSE)
    size = fixed + np.diff(role_at) + np.diff(text_at)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    out = np.empty(offsets[-1], np.uint8)
    role_to = offsets[:-1] + len(OPEN)
    start = role_to + np.diff(role_at) + len(COLON)
    end = start + np.diff(text_at)
    for mark, at in ((OPEN, offsets[:-1]), (COLON, role_to + np.diff(role_at)), (CLOSE, end)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for src, src_at, to in ((role, role_at, role_to), (text, text_at, start)):
        shift = np.repeat(to - src_at[:-1], np.diff(src_at))
        out[np.arange(len(src)) + shift] = src
    return out, offsets, start, end


def _code_points(out: np.ndarray) -> np.ndarray:
    total = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=total[1:])
    return total


def _format(loss_roles: tuple[str, ...]):
    def run(batches):
        for b in sliced(batches, 4 << 20):
            yield _parts(b, loss_roles)
    return run


def _parts(b: pa.RecordBatch, loss_roles: tuple[str, ...]) -> pa.RecordBatch:
    out, offsets, start, end = assemble(b.column("role"), b.column("text"))
    points = _code_points(out)
    ids = b.column("conv_id").to_pylist()
    change = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
    first = np.array(change[:-1])
    text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets[np.array(change)].copy()), pa.py_buffer(out))
    roles = b.column("role").to_pylist()
    own = np.array([r in loss_roles for r in roles])
    spans = [[{"start": int(points[start[i]] - points[offsets[f]]), "end": int(points[end[i]] - points[offsets[f]])}
              for i in range(f, t) if own[i]] for f, t in zip(change[:-1], change[1:])]
    place = pa.StructArray.from_arrays([b.column("turn").take(pa.array(first)), pa.array([roles[i] for i in first], pa.string()),
                                        b.column("_h").take(pa.array(first))], names=["turn", "role", "hash"])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [b.column("conv_id").take(pa.array(first)), place, pa.array(np.diff(change), pa.int64()), text.cast(pa.string()),
         pa.array(spans, kind)], names=["conv_id", "part", "n_turns", "text", "loss"])


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted conversations: (conv_id, part, n_turns, text, loss), loss = spans in code points of the text.

    turns: (conv_id, turn, role, text); other columns are ignored. Turns go in the order of turn (null first), role, hash of
    the text and text; null role or text counts as empty; equal rows all stay; a null conv_id is a conversation of its own; an
    empty table gives an empty one.

    Rows are dealt out by ranges of (conv_id, turn, role, hash), so no task needs a whole conversation, however long: a
    conversation that crosses a range or a batch comes in several rows. In the order of ``part`` their texts join to
    the whole, and their spans count from the start of their own text.
    """
    t = turns.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("_h"))
    t = t.repartitionByRange(partitions(turns.sparkSession), "conv_id", "turn", "role", "_h") \
        .sortWithinPartitions("conv_id", "turn", "role", "_h", "text")
    kinds = {f.name: f.dataType.simpleString() for f in t.schema}
    return t.mapInArrow(_format(tuple(loss_roles)), PARTS.format(id=kinds["conv_id"], turn=kinds["turn"]))


_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    out = []
    for turn in formatted.split("</turn>\n")[:-1]:
        head = re.compile(r"### ((?:\\.|[^\\:])*): ", re.DOTALL).match(turn)
        out.append((unescape(head[1]), unescape(turn[head.end():])))
    return out


def _digests(batches):
    """Streams the parts of each conversation, in order, into running digests: memory does not depend on its length."""
    now, state = None, None

    def done():
        return {"conv_id": now[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

    kind = None
    for b in batches:
        rows = []
        kind = b.schema.field("conv_id").type
        for r in b.to_pylist():
            if now is None or now[0] != r["conv_id"]:
                if now is not None:
                    rows.append(done())
                now, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(r["text"]):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for s in r["loss"]:
                own = unescape(r["text"][s["start"]:s["end"]])
                state[2] += len(own)
                state[3].update(own.encode())
            state[4] += len(r["text"])
        if rows:
            yield _rows(rows, kind)
    if now is not None:
        yield _rows([done()], kind)


def _rows(rows, kind):
    schema = pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return pa.RecordBatch.from_pylist(rows, schema)


def digests(parts: DataFrame) -> DataFrame:
    """What can be read back from formatted parts, per conversation."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    return parts.repartition(partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
        _digests, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


@query("op1_chat_format")
def op1_chat_format(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)
    return digests(format_chats(turns.unionByName(more)))
