"""Joins by keys of which some hold a large part of all rows.

A Misra-Gries sketch finds these keys: a task keeps a bounded number of counters, and what it sends undercounts a key by
no more than its rows over the number of counters. Sketches add up. The rows of frequent keys meet their partners by
broadcast, all others by shuffle, in one pass over the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.sources.workspace import materialise

# A key is frequent with more than one in so many rows.
SHARE = 1000


def reduced(counts: dict, counters: int) -> dict:
    """At most `counters` of the counts, all less the largest one that goes (Agarwal et al. 2013)."""
    if len(counts) <= counters:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    cut = int(np.partition(values, -counters - 1)[-counters - 1])
    return {k: n - cut for k, n in counts.items() if n > cut}


def _sketch(columns, counters):
    def task(batches):
        found, rows = {c: {} for c in columns}, 0
        for batch in batches:
            rows += batch.num_rows
            for c in columns:
                seen = pc.value_counts(batch.column(c).drop_null())
                for key, n in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist()):
                    found[c][key] = found[c].get(key, 0) + n
                found[c] = reduced(found[c], counters)
        out = [(c, k, n, 0) for c in columns for k, n in found[c].items()] + [(None, None, 0, rows)]
        names, keys, counts, total = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(total, pa.int64())],
            names=["name", "key", "n", "rows"],
        )

    return task


def frequent_keys(df: DataFrame, columns, share: int = SHARE) -> DataFrame:
    """(name, key): all keys (as text) of each column that more than one in `share` rows have, and some with half as many.

    There are at most 2 `share` for a column, whatever the rows. Null is no key.
    """
    slim = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    sketch = materialise(slim.mapInArrow(_sketch(list(columns), 2 * share), "name string, key string, n long, rows long"), "sketch")
    rows = sketch.agg(F.sum("rows")).first()[0] or 0
    merged = sketch.where("name IS NOT NULL").groupBy("name", "key").agg(F.sum("n").alias("n"))
    return merged.where(F.col("n") * 2 * share >= rows).select("name", "key")


def hub_join(rows: DataFrame, table: DataFrame, key: str, frequent: DataFrame) -> DataFrame:
    """Inner join of `rows` with a table that has one row for each value of `key` (and other columns).

    `frequent` lists keys (`key`, as text) whose rows of the table are broadcast. Their rows here are dealt out by all
    their values instead of the key.
    """
    values = [c for c in table.columns if c != key]
    found = table.select(F.col(key).cast("string").alias("__key"), F.struct(*values).alias("__found"))
    hubs = found.join(F.broadcast(frequent.select(F.col("key").alias("__key"))), "__key", "left_semi")
    hubs = hubs.select(F.col("__key").alias("__hub"), F.col("__found").alias("__of_hub"))
    dealt = F.when(F.col("__hub").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("\u0001"), F.xxhash64(*rows.columns).cast("string")))
    met = (
        rows.where(F.col(key).isNotNull()).join(F.broadcast(hubs), F.col(key).cast("string") == F.col("__hub"), "left")
        .withColumn("__dealt", dealt).join(found, F.col("__dealt") == F.col("__key"), "left")
        .withColumn("__row", F.coalesce("__of_hub", "__found")).where(F.col("__row").isNotNull())
    )
    return met.select(*rows.columns, *[F.col("__row")[c].alias(c) for c in values])
