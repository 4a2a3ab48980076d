"""Words and their 64-bit hashes, computed on the bytes of whole Arrow columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Text that one numpy pass may hold; whole documents stay together, so one long document may exceed it.
PASS_BYTES = 4 << 20

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_SEED = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of unsigned 64-bit integers over all bits."""
    h = h ^ (h >> _HALF)
    h = h * _M1
    h = h ^ (h >> _HALF)
    h = h * _M2
    return h ^ (h >> _HALF)


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of some texts: the text's position, byte span and, in order, all bytes."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    docs: int

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit hash for each span of bytes, read eight at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    chunks = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    length = end - start
    h = _SEED ^ length.astype(np.uint64)
    active, at, left = np.arange(len(h)), start.astype(np.int64), length.astype(np.int64)
    while len(active):
        part = chunks[at]
        short = left < 8
        if short.any():
            keep = (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            part = np.where(short, part & keep, part)
        h[active] = mix(h[active] ^ (part * _M2 + _SEED))
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    return h


def slices(column: pa.Array, limit: int = PASS_BYTES):
    """(first row, texts) of successive slices with about `limit` bytes each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield first, column.slice(first, last - first)
        first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = True) -> Words:
    """Words of a large_string array without nulls, A-Z lower-cased unless told otherwise."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(data, doc, start, end, len(column))
