"""(owner, key) pairs moved between tasks as packed arrays, dealt out by key.

A row of Spark's shuffle costs more than a pair of integers holds. Tasks therefore send, for each
bucket of keys, one row of arrays: the owners, the number of keys of each, and the keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs that a task gathers before it sends them, and about how many a bucket should receive.
SEND_PAIRS = 3_000_000
BUCKET_PAIRS = 2_000_000
LEAST_BUCKETS = 128

SCHEMA = "bucket int, owners binary, counts binary, keys binary, weights binary"
ARROW = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("owners", "counts", "keys", "weights")]])


def buckets_for(pairs: float) -> int:
    """A power of two that grows with the number of pairs."""
    need = max(LEAST_BUCKETS, pairs / BUCKET_PAIRS)
    return 1 << int(np.ceil(np.log2(need)))


def text_volume(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the high bits of unsigned 64-bit keys; buckets is a power of two."""
    bits = int(buckets).bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def pack(owners: np.ndarray, keys: np.ndarray, weights: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket that occurs. Pairs of an owner should be next to each other."""
    kind = np.uint16 if len(bucket) == 0 or bucket.max() < 65536 else np.int32
    order = np.argsort(bucket.astype(kind), kind="stable")
    owners, keys, weights, bucket = owners[order], keys[order], weights[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = []
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)]):
        if a == b:
            continue
        own = owners[a:b]
        head = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]
        counts = np.diff(np.r_[head, b - a]).astype(np.uint32)
        rows.append((int(bucket[a]), own[head].tobytes(), counts.tobytes(), keys[a:b].tobytes(), weights[a:b].tobytes()))
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)


def unpack(rows: pd.DataFrame, weight: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners, keys, weights), an entry for each pair."""
    def joined(column, kind):
        return np.frombuffer(b"".join(rows[column]), kind)

    return np.repeat(joined("owners", "u8"), joined("counts", "u4")), joined("keys", "u8"), joined("weights", weight)


def runs(*columns: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal rows in sorted columns."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(0, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)
