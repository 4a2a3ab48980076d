"""md5 of many short texts at once, for uniforms that Spark's and SQL's md5 give too."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Bytes of a block, and texts that are hashed together: their words stay in a core's cache.
BLOCK, TOGETHER = 64, 1 << 13
# RFC 1321: constants of the steps, rotations of each round, start.
_ADD = [np.uint32(k) for k in np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64)]
_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_STRIDE = ((1, 0), (5, 1), (3, 5), (7, 0))


def _padded(texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each text, then `end`, then zeros, in rows of one width; length of each text)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    lengths = np.diff(offsets)
    out = np.zeros((len(texts), int(lengths.max(initial=0)) + 1), np.uint8)
    if offsets[-1] > offsets[0]:
        of = np.repeat(np.arange(len(texts)), lengths)
        out[of, np.arange(len(of)) - (offsets[:-1] - offsets[0])[of]] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    if end is not None:
        out[np.arange(len(texts)), lengths] = end
    return out, lengths


def joined_uniforms(heads: pa.Array, tails: pa.Array, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The first 52 bits of md5(heads[head] + tails[tail]) over 2^52, for every pair of places."""
    heads = heads.dictionary_encode()
    head = heads.indices.to_numpy()[head]
    (front, front_size), (back, back_size) = _padded(heads.dictionary), _padded(tails, 0x80)
    out = np.empty(len(head))
    for a in range(0, len(head), TOGETHER):
        h, t = head[a:a + TOGETHER], tail[a:a + TOGETHER]
        size = front_size[h] + back_size[t]
        blocks = (size + 8) // BLOCK + 1
        text = np.zeros((len(h), max(int(blocks.max()) * BLOCK, front.shape[1] + back.shape[1])), np.uint8)
        for length in np.unique(front_size[h]):
            rows = np.flatnonzero(front_size[h] == length)
            text[rows, :length] = front[h[rows], :length]
            text[rows, length:length + back.shape[1]] = back[t[rows]]
        text = np.ascontiguousarray(text[:, :int(blocks.max()) * BLOCK]).view("<u4")
        # Eight bytes at most of a size in bits; texts are shorter than 2^29 bytes.
        text[np.arange(len(h)), blocks * (BLOCK // 4) - 2] = size * 8
        first, second = _digest(np.ascontiguousarray(text.T), blocks)
        bits = (first.byteswap().astype(np.uint64) << np.uint64(32)) | second.byteswap()
        out[a:a + TOGETHER] = (bits >> np.uint64(12)).astype(float) * 2.0**-52
    return out


def _digest(words: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of each column, which has as many blocks of sixteen words."""
    state = [np.full(words.shape[1], s, np.uint32) for s in _START]
    f, g = np.empty_like(state[0]), np.empty_like(state[0])
    for block in range(len(words) // 16):
        word = words[16 * block:]
        a, b, c, d = (s.copy() for s in state)
        for step in range(64):
            turn = step // 16
            if turn == 0:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif turn == 1:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif turn == 2:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += _ADD[step]
            by, start = _STRIDE[turn]
            f += word[(by * step + start) % 16]
            left = _TURN[turn][step % 4]
            np.right_shift(f, np.uint32(32 - left), out=g)
            f <<= np.uint32(left)
            f |= g
            f += b
            a, d, c, b, f = d, c, b, f, a
        more = blocks > block
        state = [np.where(more, s + x, s) for s, x in zip(state, (a, b, c, d))]
    return state[0], state[1]
