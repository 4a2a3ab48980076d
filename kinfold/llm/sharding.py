"""Shards of near equal bytes: vector bin packing of groups of equal texts.

Each group is a vector (bytes, words, rows). Groups that are large for a shard are few - at most a fixed
number per shard can exist - and are placed one by one on the driver. All others are dealt at random into
cells; each cell owns its share of every shard's remaining capacity and places its groups, large ones first,
where the dot product with the residual capacity is highest. Cells grow in number with the groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.mixing import word_count
from kinfold.sources.workspace import materialise

SHARDS = 40
# Fixed value: bytes a row needs besides its text.
ROW_BYTES = 16
# A group is large if it has this part of a shard's fair share of bytes, words or rows; a group without
# room in any shard is cut into pieces of about this part.
LARGE = 1 / 16
CELL_GROUPS = 50_000
# Rows numbered by one window.
CELL_ROWS = 100_000
PARTS = ("bytes", "words", "rows")
# Weights of the parts in the dot product: bytes are the law, the others are balanced beside it.
WEIGHTS = np.array([64.0, 1.0, 1.0])


def dot_place(items: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each item, in the order given: highest dot product with what is left, ties to the first.

    Both are scaled by the capacity; a part that is used up no longer counts. `residual` is updated.
    """
    scale = np.maximum(residual.sum(axis=0), 1e-9)
    items, left, weighted = items / scale, residual / scale, items / scale * WEIGHTS
    chosen = np.empty(len(items), np.int32)
    for i, item in enumerate(items):
        chosen[i] = k = int(np.argmax(np.maximum(left, 0.0) @ weighted[i] + 1e-6 * left[:, 0]))
        left[k] -= item
    residual[:] = left * scale
    return chosen


def level(loads: np.ndarray, total: float) -> float:
    """Height at which capacities max(load, height) add up to the total."""
    loads = np.sort(loads)
    for k in range(len(loads), 0, -1):
        height = (total - loads[k:].sum()) / k
        if height >= loads[k - 1]:
            return height
    return loads[0]


def place_large(items: pd.DataFrame, totals: np.ndarray, shards: int):
    """(shard of each item, keys without room, residual) for large groups and pieces (key, piece, bytes, words, rows).

    An item goes among the shards with room for its bytes where the dot product is highest; without any, to the emptiest.
    """
    fair = totals / shards
    scale = np.maximum(fair, 1e-9)
    residual = np.tile(fair, (shards, 1))
    chosen, homeless = np.zeros(len(items), np.int64), []
    parts = items[list(PARTS)].to_numpy(float)
    for i in np.lexsort((items["piece"], items["key"], -parts[:, 2], -parts[:, 0])):
        inside = np.flatnonzero(residual[:, 0] >= parts[i, 0])
        if not len(inside):
            homeless.append(items["key"].iloc[i])
            inside = np.array([int(np.argmax(residual[:, 0]))])
        gain = np.maximum(residual[inside], 0.0) / scale @ (WEIGHTS * parts[i] / scale)
        chosen[i] = k = int(inside[np.argmax(gain + 1e-6 * residual[inside, 0] / scale[0])])
        residual[k] -= parts[i]
    loads = fair - residual
    heights = np.array([level(loads[:, d], totals[d]) for d in range(3)])
    return chosen, homeless, np.maximum(heights - loads, 0.0)


def _pieces(rows: DataFrame, cuts: dict[str, int]) -> DataFrame:
    """The rows of groups that are cut, with their piece; cuts are as few as large groups."""
    table = rows.sparkSession.createDataFrame(list(cuts.items()), "key string, pieces int")
    return rows.join(F.broadcast(table), "key").withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces").cast("long")).cast("int"))


def _place_with_cuts(rows: DataFrame, large: pd.DataFrame, totals: np.ndarray, shards: int):
    """(cuts, placements (key, piece, shard), residual): groups without room are cut, counted and placed again."""
    cuts: dict[str, int] = {}
    piece = max(totals[0] / shards * LARGE, 1.0)
    whole = large.assign(piece=0)[["key", "piece", *PARTS]]
    homeless = large["key"][large["bytes"] > totals[0] / shards].tolist()
    while True:
        several = large[large["key"].isin(homeless) & (large["rows"] > 1) & ~large["key"].isin(cuts)]
        cuts |= {r.key: int(min(r.rows, np.ceil(r.bytes / piece))) for r in several.itertuples()}
        items = whole[~whole["key"].isin(cuts)]
        if cuts:
            counted = _pieces(rows, cuts).groupBy("key", "piece").agg(
                F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows")
            ).toPandas()
            items = pd.concat([items, counted], ignore_index=True)
        chosen, homeless, residual = place_large(items, totals, shards)
        again = large[large["key"].isin(homeless) & (large["rows"] > 1) & ~large["key"].isin(cuts)]
        if again.empty:
            return cuts, [(k, int(p), int(c)) for k, p, c in zip(items["key"], items["piece"], chosen)], residual


def _place_cell(residual: np.ndarray):
    """Place a cell's groups within the cell's part of every shard's remaining capacity."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "words", "rows", "key"], ascending=False)
        items = pdf[list(PARTS)].to_numpy(float)
        share = items.sum(axis=0) / np.maximum(residual.sum(axis=0), 1e-9)
        return pd.DataFrame({"key": pdf["key"], "shard": dot_place(items, residual * share)})

    return place


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `bytes`: sizes are near equal, words and rows are balanced beside them as far as groups allow. Equal texts
    share a shard; a group is cut by doc_id only where no shard has room for it. Null texts count as empty. Rows that
    repeat a doc_id are placed and numbered each. Slots run from 0 without gaps in each shard. An empty table gives
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), word_count(text).alias("words"), F.md5(text.cast("binary")).alias("key"),
        ),
        "rows",
    )
    groups = materialise(
        rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows")), "groups"
    )
    count, *sums = groups.agg(F.count(F.lit(1)), *[F.sum(c) for c in PARTS]).first()
    totals = np.array([float(s or 0) for s in sums])
    bound = [float(t) / shards * LARGE for t in totals]
    is_large = F.greatest(*[(F.col(c) >= F.lit(max(b, 1.0))).cast("int") for c, b in zip(PARTS, bound)]) == 1
    # At most 3 * shards / LARGE groups can be large.
    large = groups.where(is_large).toPandas()
    cuts, placed, residual = _place_with_cuts(rows, large, totals, shards)

    cells = max(1, -(-int(count or 0) // CELL_GROUPS))
    light = (
        groups.where(~is_large).withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
        .groupBy("cell").applyInPandas(_place_cell(residual), "key string, shard int")
    )
    spots = F.broadcast(spark.createDataFrame(placed, "key string, piece int, shard int"))
    heavy = F.broadcast(spark.createDataFrame([(k,) for k in large["key"]], "key string"))
    columns = ["doc_id", "size", "text_crc32", "shard"]
    whole_or_light = rows if not cuts else rows.join(F.broadcast(spark.createDataFrame([(k,) for k in cuts], "key string")), "key", "left_anti")
    of_cut = _pieces(rows, cuts).join(spots, ["key", "piece"])
    of_whole = whole_or_light.join(spots.drop("piece"), "key")
    of_light = rows.join(heavy, "key", "left_anti").join(light, "key")
    sharded = materialise(of_cut.select(*columns).unionByName(of_whole.select(*columns)).unionByName(of_light.select(*columns)), "sharded")
    return _numbered(sharded).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _numbered(sharded: DataFrame) -> DataFrame:
    """A gapless slot in each shard: the place within a cell of the shard, after all rows of earlier cells."""
    rows = sharded.count()
    cells = max(1, -(-rows // CELL_ROWS))
    dealt = sharded.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    sizes = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return dealt.withColumn("place", F.row_number().over(place)).join(starts, ["shard", "cell"]).withColumn(
        "slot", (F.col("start") + F.col("place") - 1).cast("long")
    )
