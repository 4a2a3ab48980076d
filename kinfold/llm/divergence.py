"""Divergence of sources: smoothed term rates of every group (language, source) against each other and the language.

Tasks count the terms of the texts they read by group, so a hot source or a hot term is one row of a task before
anything moves. The kept terms of a language are numbered in order, and a group's counts become arrays of
(term number, count) in order of number, one for every BLOCK numbers. A pair task takes the two arrays of a pair of
groups for one block: the shorter one gallops through the longer one, which gives the overlap; terms of one side
only, and of neither, are priced with the rate that a count of zero has. Its sums over blocks belong to both groups.

Everything is exact in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.words import LOWER, slices, text_bytes
from kinfold.operators.ranks import ranked
from kinfold.sources.workspace import materialise

# A term is kept in a language with this many documents or more; `term` rows go to this rank.
LEAST_DOCUMENTS, TERM_RANKS = 30, 50
# Rates are floor(SCALE (count + SMOOTH) / (N + SMOOTH V)) + 1.
SCALE, SMOOTH = 1_000_000_000, 5
# Term numbers that one array may span, 2^16 at most.
BLOCK = 1 << 16
# Numbers that gallop together.
STRIDE = 256
# Cells that a task holds before they leave it, and that leave at a time.
HELD_CELLS, BATCH_CELLS = 1 << 20, 1 << 16

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
COUNTS = "lang string, source string, term string, count long, docs long"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(text, term) of each term, in order: runs of ASCII letters and code points from 0x80, A-Z lower-cased."""
    data, offsets = text_bytes(texts)
    inside = LETTERS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    head = inside.copy()
    head[1:] &= ~inside[:-1] | edge[1:-1]
    start = np.flatnonzero(head)
    # Bytes of all terms follow each other, so a term ends where the next begins.
    kept = LOWER[data[inside]]
    ends = np.r_[(np.cumsum(inside) - 1)[start], len(kept)]
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)])
    return np.searchsorted(offsets, start, "right") - 1, terms


def _cells(lang: pa.Array, source: pa.Array, texts: pa.Array) -> pa.Table:
    """Occurrences and documents of each term in each group, of a slice of texts."""
    doc, terms = terms_of(texts)
    coded, lang, source = terms.dictionary_encode(), lang.dictionary_encode(), source.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    pair, times = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    cells, place = np.unique(group[pair // size] * size + pair % size, return_inverse=True)
    return pa.table({
        "lang": lang.dictionary.take(pa.array(cells // size // len(source.dictionary))),
        "source": source.dictionary.take(pa.array(cells // size % len(source.dictionary))),
        "term": coded.dictionary.take(pa.array(cells % size)).cast(pa.binary()).cast(pa.string()),
        "count": np.bincount(place, times).astype(np.int64), "docs": np.bincount(place).astype(np.int64),
    })


def _counted(batches):
    """Counts of a task; cells of several slices are added up before they leave it."""

    def added(tables):
        table = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("count", "sum"), ("docs", "sum")])
        return table.select(["lang", "source", "term", "count_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "count", "docs"])

    held = []
    for batch in batches:
        lang, source = (pc.struct_field(batch.column("grp"), [k]) for k in (0, 1))
        for first, texts in slices(batch.column("text")):
            held.append(_cells(lang.slice(first, len(texts)), source.slice(first, len(texts)), texts))
            if sum(map(len, held)) > HELD_CELLS:
                held = [added(held)]
                if len(held[0]) > HELD_CELLS // 2:
                    yield from held.pop().to_batches(max_chunksize=BATCH_CELLS)
    if held:
        yield from added(held).to_batches(max_chunksize=BATCH_CELLS)


def rates(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE (count + SMOOTH) / total), exact: three digits of the quotient at a time."""
    left, found = count + SMOOTH, np.zeros(len(count), np.int64)
    found = left // total
    left = left % total
    for _ in range(3):
        found = found * 1000 + left * 1000 // total
        left = left * 1000 % total
    return 1 + found


def gallop(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """For each number of `small`, the place of the first number in `large` not below it; both ascend.

    A bound moves ahead from the last place in doubling steps until it passes the next STRIDE numbers, which are then
    searched for below it; stretches of the larger array that hold none of them are skipped.
    """
    places, low = np.empty(len(small), np.int64), 0
    for at in range(0, len(small), STRIDE):
        part = small[at:at + STRIDE]
        step = STRIDE
        high = low + step
        while high < len(large) and large[high - 1] < part[-1]:
            step *= 2
            high += step
        places[at:at + STRIDE] = low + np.searchsorted(large[low:high], part)
        low = int(places[min(at + STRIDE, len(small)) - 1])
    return places


def distance(ids_a, counts_a, total_a, ids_b, counts_b, total_b, terms: int) -> int:
    """Sum over a block's `terms` of the distance of the rates of a and b; ids ascend, a term not listed has count 0."""
    if len(ids_a) > len(ids_b):
        ids_a, counts_a, total_a, ids_b, counts_b, total_b = ids_b, counts_b, total_b, ids_a, counts_a, total_a
    at = gallop(ids_a, ids_b)
    both = np.zeros(len(ids_a), bool)
    inside = at < len(ids_b)
    both[inside] = ids_b[at[inside]] == ids_a[inside]
    rate_a, rate_b = rates(counts_a, total_a), rates(counts_b, total_b)
    none_a, none_b = (int(rates(np.zeros(1, np.int64), t)[0]) for t in (total_a, total_b))
    only_b = np.ones(len(ids_b), bool)
    only_b[at[both]] = False
    absent = terms - len(ids_a) - len(ids_b) + int(both.sum())
    return int(
        np.abs(rate_a[both] - rate_b[at[both]]).sum() + np.abs(rate_a[~both] - none_b).sum()
        + np.abs(none_a - rate_b[only_b]).sum() + absent * abs(none_a - none_b)
    )


def _packed(block: int):
    """The arrays of a block as bytes: places in the block of 16 bits, counts of 64."""

    def task(batches):
        for batch in batches:
            out = []
            for column, kind, base in (("numbers", "<u2", block), ("counts", "<i8", None)):
                lists = batch.column(column)
                values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                values = (values % base if base else values).astype(kind)
                out.append(pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()))
            kept = ["lang", "source", "block", "total", "terms"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *out], names=[*kept, "numbers", "counts"])

    return task


def _priced(batches):
    """The distance of each row's two arrays."""
    def read(value, kind):
        return np.frombuffer(value.as_buffer(), kind)

    for batch in batches:
        c = {name: batch.column(name) for name in batch.schema.names}
        out = [
            distance(
                read(c["numbers_a"][i], "<u2"), read(c["counts_a"][i], "<i8"), c["total_a"][i].as_py(),
                read(c["numbers_b"][i], "<u2"), read(c["counts_b"][i], "<i8"), c["total_b"][i].as_py(), c["terms"][i].as_py(),
            )
            for i in range(batch.num_rows)
        ]
        yield pa.RecordBatch.from_arrays([c["lang"], c["a"], c["b"], pa.array(out, pa.int64())], names=["lang", "a", "b", "value"])


def rate(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH kept)), in decimals."""
    above = (count + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", above, (total + SMOOTH * kept).cast("decimal(20,0)")) + 1


class Audit:
    """Counts of a corpus; its parts read the same written tables.

    `groups`: lang, source, total (occurrences of kept terms), kept (terms kept in the language).
    `cells`: lang, source, number, term, count, lang_count of every kept term of every group that has it.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block: int = BLOCK):
        self.block = block

        def whole(c):
            return F.coalesce(F.col(c).cast("string"), F.lit(""))

        rows = docs.select(F.struct(whole(lang_col).alias("lang"), whole(source_col).alias("source")).alias("grp"), whole(text_col).alias("text"))
        # Dealt out by (lang, term), all that follows for a term is in one task, with a row for each of its groups.
        found = (
            rows.mapInArrow(_counted, COUNTS).repartition("lang", "term")
            .groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
        )
        term = Window.partitionBy("lang", "term")
        found = found.withColumn("lang_count", F.sum("count").over(term)).withColumn("docs", F.sum("docs").over(term))
        found = materialise(found.where(F.col("docs") >= least).drop("docs"), "counts")
        terms = found.groupBy("lang", "term").agg(F.first("lang_count").alias("lang_count"))
        terms = ranked(terms, ["lang"], ["term"], "terms").withColumnsRenamed({"rank0": "number", "total": "kept"})
        terms = materialise(terms, "numbered")
        self.cells = materialise(found.join(terms.drop("kept", "lang_count"), ["lang", "term"]), "cells")
        self.langs = terms.groupBy("lang").agg(F.max("kept").alias("kept"), F.sum("lang_count").alias("lang_total"))
        totals = self.cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        every = rows.select("grp.*").distinct()
        self.groups = materialise(
            every.join(totals, ["lang", "source"], "left").join(self.langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"]), "groups"
        )

    def blocks(self) -> DataFrame:
        """lang, source, block, total, terms (of the block), numbers, counts (bytes): a row per group and block, also
        where the group has no term of the block."""
        spans = F.sequence(F.lit(0).cast("long"), F.floor((F.col("kept") - 1) / self.block))
        grid = self.groups.where(F.col("kept") > 0).select(
            "lang", "source", (F.col("total") + SMOOTH * F.col("kept")).alias("total"), "kept", F.explode(spans).alias("block")
        )
        cell = F.struct("number", "count")
        arrays = self.cells.groupBy("lang", "source", F.floor(F.col("number") / self.block).alias("block")).agg(F.sort_array(F.collect_list(cell)).alias("c"))
        filled = F.coalesce("c", F.array().cast("array<struct<number:long,count:long>>"))
        rows = grid.join(arrays, ["lang", "source", "block"], "left").select(
            "lang", "source", "block", "total", F.least(F.lit(self.block), F.col("kept") - self.block * F.col("block")).alias("terms"),
            filled["number"].alias("numbers"), filled["count"].alias("counts"),
        )
        return rows.mapInArrow(_packed(self.block), "lang string, source string, block long, total long, terms long, numbers binary, counts binary")

    def distances(self) -> DataFrame:
        """lang, a, b (sources, a < b), value: one row for every unordered pair of a language's sources."""
        blocks = materialise(self.blocks(), "blocks")
        names = blocks.select("lang", "source", "block")
        pairs = names.withColumnRenamed("source", "a").join(names.withColumnRenamed("source", "b"), ["lang", "block"]).where(F.col("a") < F.col("b"))
        arrays = ["total", "numbers", "counts"]
        tasks = pairs.join(blocks.select("lang", "block", "terms", F.col("source").alias("a"), *[F.col(c).alias(f"{c}_a") for c in arrays]), ["lang", "a", "block"])
        tasks = tasks.join(blocks.select("lang", "block", F.col("source").alias("b"), *[F.col(c).alias(f"{c}_b") for c in arrays]), ["lang", "b", "block"])
        priced = tasks.mapInArrow(_priced, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        # Languages without kept terms have no arrays; their pairs are all alike.
        bare = self.groups.where(F.col("kept") == 0).select("lang", "source")
        alike = bare.withColumnRenamed("source", "a").join(bare.withColumnRenamed("source", "b"), "lang").where(F.col("a") < F.col("b"))
        return priced.unionByName(alike.withColumn("value", F.lit(0).cast("long")))

    def shifts(self) -> DataFrame:
        """lang, source, term, p, q, of every kept term that a group has at a higher rate than its language."""
        totals = self.groups.select("lang", "source", "total", "kept", "lang_total")
        return self.cells.join(totals, ["lang", "source"]).select(
            "lang", "source", "term", rate(F.col("count"), F.col("total"), F.col("kept")).alias("p"),
            rate(F.col("lang_count"), F.col("lang_total"), F.col("kept")).alias("q"),
        ).where("p > q")


def divergence_report(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS,
                      lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its distance to every other source of the language (`pair`)
    and the terms furthest above the language's rate, to rank `ranks` (`term`). Ranks go by value descending, then item.

    A rate is 1 + floor(10^9 (count + 5) / (N + 5 V)), of the group or the language, over the V terms in at least
    `least` of the language's documents. Null text, lang and source count as ''. A group without terms has rates of
    zero counts; a language without kept terms has distances of 0 and no term rows. Repeated rows count each, ids play
    no part, equal values are ranked by item. An empty table gives an empty result; other columns are ignored.
    """
    audit = Audit(docs, least, lang_col, source_col, text_col, block)
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = audit.distances().select("lang", F.explode(both).alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    terms = audit.shifts().select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first)
