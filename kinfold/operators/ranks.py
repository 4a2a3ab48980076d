"""Positions and average ranks within groups of any size, by a distributed prefix scan.

Rows are range-partitioned and sorted by (keys, order), so a hot group, or a value that very many rows share, spans
many tasks. A task walks its sorted rows in stretches: groups and runs of equal values that lie inside a stretch are
numbered there and then. Those at its ends are segments; each gives one row of a small table, in which consecutive
segments of a group or run add up and carry their sums over the border. That table is sent to all rows, so nothing is
joined by keys or values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinfold.sources.workspace import materialise

# Rows of a stretch. The table of segments has at most four rows for so many rows, and four for a task.
STRETCH = 1 << 18
# The task; then for the row's group and for its run of equal values: number of the segment's first row in the task (-1
# where all rows are in the stretch), place in the segment, rows of the segment.
WALKED = "__part int, __seg long, __place long, __rows long, __tie_seg long, __tie_place long, __ties long"


def _changes(rows: pa.RecordBatch, columns) -> np.ndarray:
    """Whether each row begins anew in some column; the first does. Nulls are alike, and so are NaNs."""
    found = np.zeros(rows.num_rows, bool)
    found[0] = True
    for name in columns:
        column = rows.column(name)
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(column.type):
            same = pc.or_(same, pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False)))
        found[1:] |= ~same.to_numpy(zero_copy_only=False)
    return found


def _segments(new: np.ndarray, first: int) -> list[np.ndarray]:
    """Segment, place in it and rows of it, for each row; `first` is the number of the first row in the task."""
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(new)])
    segment = np.full(len(starts), -1, np.int64)
    segment[[0, -1]] = starts[[0, -1]] + first
    which = np.cumsum(new) - 1
    return [segment[which], np.arange(len(new)) - starts[which], sizes[which]]


def _walk(keys, tie):
    names = [c.split()[0] for c in WALKED.split(", ")]

    def walked(batches, first):
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        new = _changes(rows, keys)
        runs = new | _changes(rows, [tie]) if tie else new
        part = np.full(rows.num_rows, TaskContext.get().partitionId(), np.int32)
        found = [part, *_segments(new, first), *_segments(runs, first)]
        return pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, found)], names=[*rows.schema.names, *names])

    def task(batches):
        held, count, first = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= STRETCH:
                yield walked(held, first)
                held, count, first = [], 0, first + count
        if held:
            yield walked(held, first)

    return task


def _carried(rows: DataFrame, within, segment: str, place: str, size: str, name: str) -> DataFrame:
    """For each segment, the rows of its group (or run) before it and in all."""
    every = Window.partitionBy(*within)
    earlier = every.orderBy("__part", segment).rowsBetween(Window.unboundedPreceding, -1)
    return rows.where((F.col(segment) >= 0) & (F.col(place) == 0)).select(
        F.col("__part").alias(f"{name}_part"), F.col(segment).alias(f"{name}_seg"),
        F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(f"{name}_before"), F.sum(size).over(every).alias(f"{name}_all"),
    )


def _placed(df: DataFrame, keys, order, tie, name) -> DataFrame:
    keys = list(keys)
    sort = keys + list(order)
    schema = StructType(df.schema.fields + StructType.fromDDL(WALKED).fields)
    walk = df.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(_walk(keys, tie), schema)
    rows = materialise(walk, name)
    groups = _carried(rows, keys, "__seg", "__place", "__rows", "__g")
    found = rows.join(F.broadcast(groups), (F.col("__part") == F.col("__g_part")) & (F.col("__seg") == F.col("__g_seg")), "left")
    found = found.withColumn("rank0", F.col("__place") + F.coalesce("__g_before", F.lit(0))).withColumn("total", F.coalesce("__g_all", "__rows"))
    if tie:
        runs = _carried(rows, [*keys, tie], "__tie_seg", "__tie_place", "__ties", "__t")
        found = found.join(F.broadcast(runs), (F.col("__part") == F.col("__t_part")) & (F.col("__tie_seg") == F.col("__t_seg")), "left")
        before = F.col("rank0") - F.col("__tie_place") - F.coalesce("__t_before", F.lit(0))
        found = found.withColumn("avg_rank", before + (F.coalesce("__t_all", "__ties") + 1) / 2)
    return found.select(*df.columns, "rank0", "total", *(["avg_rank"] if tie else []))


def ranked(df: DataFrame, keys, order, name="rank") -> DataFrame:
    """Add `rank0` (0-based position within the keys) and `total` (rows of the keys).

    `order` should end in a unique column so that equal values spread over tasks too. The walked rows are written once.
    """
    return _placed(df, keys, order, None, name)


def dense_codes(df: DataFrame, column: str, name="codes") -> DataFrame:
    """Distinct values with integer codes from 0, in value order."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return ranked(distinct, [], [column], name).select(column, F.col("rank0").alias("code"))


def average_ranks(df: DataFrame, keys, value: str, order) -> DataFrame:
    """Ranks from 1 with ties averaged, as column `avg_rank`, beside `rank0` and `total`."""
    return _placed(df, keys, [value, *order], value, "rank")
