"""Chat formatting: turns of a conversation as one text, assembled column by column.

Each turn becomes `### role: text </turn>` and a line end. In texts and roles a backslash goes before every
control character (`\\`, `#`, `<`, and in roles `:` and a space), so no text can hold a mark and the format reads back exactly.
Lengths of all segments, their running offsets and the places to copy to are computed for a whole batch, and headers,
contents and ends are copied into one buffer that becomes the Arrow column.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.words import text_bytes

# The marks, the escape and what it goes before.
OPEN, MIDDLE, CLOSE, ESCAPE = b"### ", b": ", b" </turn>\n", ord("\\")
IN_TEXT, IN_ROLE = b"\\#<", b"\\#<: "
# Bytes of texts put into one buffer; a turn is never cut.
BUFFER_BYTES = 8 << 20
# The role whose texts bear loss.
LEARNED = "assistant"


def escaped(column: pa.Array, control: bytes):
    """(bytes, offsets) of a large_string array with an escape before each control byte."""
    data, offsets = text_bytes(column)
    marked = np.isin(data, np.frombuffer(control, np.uint8))
    shift = np.cumsum(marked)
    out = np.full(len(data) + (int(shift[-1]) if len(data) else 0), ESCAPE, np.uint8)
    # A byte moves by the escapes up to and including its own; what is left over are the escapes.
    out[np.arange(len(data)) + shift] = data
    return out, offsets + np.r_[0, shift][offsets]


def scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy the segments of `data` to the places `at`."""
    length = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], length) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array):
    """(bytes, turn offsets, content starts, content ends) of all turns."""
    n = len(texts)
    role, role_at = escaped(roles, IN_ROLE)
    text, text_at = escaped(texts, IN_TEXT)
    marks = [(np.tile(np.frombuffer(m, np.uint8), n), np.arange(n + 1) * len(m)) for m in (OPEN, MIDDLE, CLOSE)]
    segments = [marks[0], (role, role_at), marks[1], (text, text_at), marks[2]]
    lengths = np.column_stack([np.diff(o) for _, o in segments]).astype(np.int64)
    places = np.r_[0, np.cumsum(lengths.ravel())]
    out = np.empty(int(places[-1]), np.uint8)
    starts = places[:-1].reshape(n, 5) if n else places[:0].reshape(0, 5)
    for k, (data, offsets) in enumerate(segments):
        scatter(out, starts[:, k], data, offsets)
    return out, np.r_[starts[:, 0], places[-1]], starts[:, 3], starts[:, 4]


FORMATTED = "conv_id long, part int, n_turns int, formatted string, content_starts array<int>, content_ends array<int>, loss array<boolean>"
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
_NAMES = [f.split()[0] for f in FORMATTED.split(", ")]


def _whole(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_string()), "")


def _format(batches):
    """Parts of conversations from ordered turns: one for a conversation within a buffer, more if it goes on."""
    before, part = None, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
        first = 0
        while first < batch.num_rows:
            base = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, base + BUFFER_BYTES, "right")))
            rows = batch.slice(first, last - first)
            first = last
            known = rows.column("conv_id").is_valid().to_numpy(zero_copy_only=False)
            conv = pc.fill_null(rows.column("conv_id"), 0).to_numpy(zero_copy_only=False)
            learned = pc.fill_null(pc.equal(rows.column("role"), LEARNED), False).to_numpy(zero_copy_only=False)
            out, turns, starts, ends = assemble(_whole(rows.column("role")), _whole(rows.column("text")))
            head = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (known[1:] != known[:-1])])
            cuts = np.r_[head, len(conv)]
            offsets = turns[cuts]
            numbers = np.zeros(len(head), np.int32)
            now = (int(conv[0]), bool(known[0]))
            numbers[0] = part = part + 1 if now == before else 0
            if len(head) > 1:
                part = 0
            before = (int(conv[-1]), bool(known[-1]))
            counts = np.diff(cuts)
            at = pa.array(cuts.astype(np.int32))
            base_of = np.repeat(offsets[:-1], counts)
            text = pa.Array.from_buffers(pa.string(), len(head), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([
                pa.array(conv[head], pa.int64(), mask=~known[head]), pa.array(numbers), pa.array(counts.astype(np.int32)), text,
                pa.ListArray.from_arrays(at, pa.array((starts - base_of).astype(np.int32))),
                pa.ListArray.from_arrays(at, pa.array((ends - base_of).astype(np.int32))),
                pa.ListArray.from_arrays(at, pa.array(learned)),
            ], names=_NAMES)


def format_chat(conversations: DataFrame) -> DataFrame:
    """Parts of formatted conversations, in order within each partition.

    Input columns conv_id, turn, role, text; turns of a conversation go by turn, then role and text, null first. A
    part has the formatted text, the byte span of each turn's (escaped) content, and whether it bears loss. A
    conversation too long for a buffer comes in several parts, numbered from 0, that follow each other. Null texts and
    roles count as empty, a null conv_id is a conversation of its own. An empty table gives an empty result; other
    columns are ignored.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.drop("turn").mapInArrow(_format, FORMATTED)


def unescaped(content: bytes) -> str:
    """Without the escapes; a character after an escape stands for itself."""
    pieces = content.decode().split("\\\\")
    return "\\".join(p.replace("\\", "") for p in pieces)


def read_turns(formatted: bytes):
    """(role, text) of each turn of a formatted part."""
    for turn in formatted.split(CLOSE)[:-1]:
        role, text = turn[len(OPEN):].split(MIDDLE, 1)
        yield unescaped(role), unescaped(text)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(parts: DataFrame) -> DataFrame:
    """What the formatted parts say when read back, one row per conversation.

    `parts` are as format_chat leaves them: the parts of a conversation follow each other in one partition.
    """
    names = [f.split()[0] for f in DIGESTS.split(", ")]

    def task(batches):
        conv, state, done = None, None, []

        def closed():
            turns, every, loss, loss_chars, chars = state
            return conv[0], turns, every.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] == 0:
                    if state:
                        done.append(closed())
                    conv, state = (row["conv_id"],), [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                content = row["formatted"].encode()
                for role, text in read_turns(content):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for start, end, loss in zip(row["content_starts"], row["content_ends"], row["loss"]):
                    if loss:
                        text = unescaped(content[start:end])
                        state[2].update(text.encode())
                        state[3] += len(text)
                state[4] += len(row["formatted"])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _DIGEST_TYPES)], names=names) if done else _none(names)
            done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(), _DIGEST_TYPES)], names=names)

    return parts.mapInArrow(task, DIGESTS)


_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _none(names):
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in _DIGEST_TYPES], names=names)
