"""Chat formatting by columnar byte assembly.

Turns of a conversation become one string: for each, `[INST]role[/INST]text</s>`, after a leading `<s>`.  Roles and texts are
escaped: a backslash becomes two, and a backslash goes after the first character of each control string, so that no control string
is left and removing single backslashes undoes it.  The loss mask is the byte spans of assistant texts.

Assembly: for all turns of a batch at once, escapes are located in the joined bytes, segment lengths are added up to offsets, and
headers, texts and inserted bytes are scattered by computed indices into one preallocated Arrow buffer.

Turns are dealt by conversation and sorted in the partition, then streamed: only the current batch and the unfinished
conversation are held, the latter in whole, as it is one output value.

Edge cases: null texts and roles are empty; null turn numbers come first; equal turn numbers are ordered by role, then text; rows
with a null conversation id form one conversation; repeated rows are turns of their own; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._util import ship

BEGIN, ROLE, TEXT, END = b"<s>", b"[INST]", b"[/INST]", b"</s>"
#: Strings that no role or text may hold unescaped.
CONTROLS = (b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>")
ESCAPE = 0x5C
MASKED_ROLE = b"assistant"


def escapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places after which a backslash goes: every backslash, and the first byte of every control string within one segment."""
    mark = buf == ESCAPE
    for control in CONTROLS:
        n = len(control)
        at = np.flatnonzero(buf[: len(buf) - n + 1] == control[0]) if len(buf) >= n else np.zeros(0, np.int64)
        for k in range(1, n):
            at = at[buf[at + k] == control[k]]
        if len(at):
            segment = np.searchsorted(starts, at, side="right") - 1
            mark[at[at + n <= ends[segment]]] = True
    return np.flatnonzero(mark)


def assemble(conversation: np.ndarray, roles: list[bytes], texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of the conversations, and the mask: string number, first and last byte within it.

    conversation: each turn's conversation, numbered from 0 in order.
    """
    n = len(roles)
    segments = [x for pair in zip(roles, texts, strict=True) for x in pair]
    buf = np.frombuffer(b"".join(segments), np.uint8)
    size = np.fromiter(map(len, segments), np.int64, 2 * n)
    ends = np.cumsum(size)
    starts = ends - size
    # an empty segment never owns a byte: the last of equal starts does
    at = escapes(buf, starts, ends)
    owner = np.searchsorted(ends, at, side="right")
    grown = size + np.bincount(owner, minlength=2 * n)
    # every turn: [first of its conversation: BEGIN] ROLE role TEXT text END
    first = np.append(True, conversation[1:] != conversation[:-1])[:n]
    lead = len(BEGIN) * first
    turn_size = lead + len(ROLE) + grown[0::2] + len(TEXT) + grown[1::2] + len(END)
    turn_end = np.cumsum(turn_size)
    turn_start = turn_end - turn_size
    role_at = turn_start + lead + len(ROLE)
    text_at = role_at + grown[0::2] + len(TEXT)
    out = np.empty(int(turn_end[-1]) if n else 0, np.uint8)

    def put(where: np.ndarray, what: bytes) -> None:
        out[(where[:, None] + np.arange(len(what))).ravel()] = np.tile(np.frombuffer(what, np.uint8), len(where))

    put(turn_start[first], BEGIN)
    put(role_at - len(ROLE), ROLE)
    put(text_at - len(TEXT), TEXT)
    put(turn_end - len(END), END)
    target = np.empty(2 * n, np.int64)
    target[0::2], target[1::2] = role_at, text_at
    # a byte moves by its segment's shift and by the backslashes before it in the segment
    before = np.zeros(len(buf) + 1, np.int64)
    np.add.at(before, at + 1, 1)
    before = np.cumsum(before)
    shift = np.repeat(target - starts - before[starts], size)
    place = np.arange(len(buf)) + shift + before[:-1]
    out[place] = buf
    out[place[at] + 1] = ESCAPE
    bounds = np.append(turn_start[first], len(out))
    strings = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    masked = np.flatnonzero(np.fromiter((r == MASKED_ROLE for r in roles), bool, n))
    own = np.cumsum(first)[masked] - 1
    return strings, own, text_at[masked] - bounds[own], text_at[masked] + grown[1::2][masked] - bounds[own]


_OUT = "conv_id {kind}, formatted string, loss_start array<long>, loss_stop array<long>"


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        keys = [r[0] for r in rows]
        new = np.array([True, *(a != b for a, b in zip(keys[1:], keys, strict=False))])
        strings, own, start, stop = assemble(np.cumsum(new) - 1, [r[1] for r in rows], [r[2] for r in rows])
        counts = np.append(0, np.cumsum(np.bincount(own, minlength=len(strings)))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(counts), pa.array(x)) for x in (start, stop)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, f in zip(keys, new, strict=True) if f], kind), strings.cast(pa.string()), *lists], names=["conv_id", "formatted", "loss_start", "loss_stop"])

    kind = None
    for batch in batches:
        kind = batch.column("conv_id").type
        keys = batch.column("conv_id").to_pylist()
        text = lambda c: [b"" if v is None else v.encode() for v in batch.column(c).to_pylist()]  # noqa: B023, E731
        held += zip(keys, text("role"), text("text"), strict=True)
        last = len(held)
        while last and held[last - 1][0] == held[-1][0]:
            last -= 1
        if last:
            yield flush(held[:last], kind)
            held = held[last:]
    if held:
        yield flush(held, kind)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_start, loss_stop (byte spans of the loss mask in formatted) of every conversation."""
    ship(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format, _OUT.format(kind=kind))


def unescape(text: bytes) -> bytes:
    """Undo the escapes: of two backslashes one goes, a single one goes."""
    return re.sub(rb"\\(\\?)", rb"\1", text)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The turns of a formatted conversation."""
    body = formatted[len(BEGIN) :]
    turns = []
    for turn in body.split(END)[:-1]:
        role, _, text = turn[len(ROLE) :].partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {c: [] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for value, start, stop in zip(*(batch.column(c) for c in ("formatted", "loss_start", "loss_stop")), strict=True):
            whole = value.as_py()
            raw = whole.encode()
            turns = parse(raw)
            loss = b"".join(unescape(raw[a:b]) for a, b in zip(start.as_py(), stop.as_py(), strict=True))
            rows["n_turns"].append(len(turns))
            rows["turns_sha256"].append(hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest())
            rows["loss_chars"].append(len(loss.decode()))
            rows["loss_sha256"].append(hashlib.sha256(loss).hexdigest())
            rows["formatted_chars"].append(len(whole))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(rows[c], pa.string() if "sha" in c else pa.int64()) for c in rows)], names=["conv_id", *rows])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read back from their strings and masks."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_start", "loss_stop").mapInArrow(_digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
