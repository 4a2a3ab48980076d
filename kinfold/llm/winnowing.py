"""Winnowing fingerprints of texts, with column functions only.

Units are the words of a text; a word of more than LONG_WORD code points, as lines of an unspaced script or of encoded data
are, counts as its code points. Every run of GRAM units has a rolling hash, the cyclic polynomial over the units' hashes,
and of every WINDOW consecutive hashes the smallest is kept, the rightmost of equal ones, with its position. Two texts that
share a run of GRAM + WINDOW - 1 units share a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.sources.workspace import materialise, parallelism

# Powers of two: runs and windows are put together from halves.
GRAM, WINDOW = 4, 8
LONG_WORD = 32
SPACES = r"[\x20\x09-\x0D]+"
LONG = r"[^\x20\x09-\x0D]{%d}" % (LONG_WORD + 1)
# The first bits of a hash and its position share one number: hash bits above, position (counted backwards) below, so the
# smallest number is the smallest hash with the rightmost position.
POSITION_BITS = 30
LAST = (1 << POSITION_BITS) - 1
# Blocks of ids, by rows, for each task of a shuffle; tasks that work on them, for each.
TASK_BLOCKS, BLOCK_TASKS = 16, 2


def units(text: Column) -> Column:
    """The words, long ones as their code points."""
    words = F.filter(F.split(text, SPACES, -1), lambda w: w != "")
    cut = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w))))
    return F.when(text.rlike(LONG), cut).otherwise(words)


def kept(text: Column) -> Column:
    """Kept hashes with positions, in order; empty without words."""
    return bound(bound(F.transform(units(text), lambda w: F.xxhash64(w)), _grams), _minima)


def _halves(values: Column, width: int, join) -> Column:
    """For each place, the `width` values from there on joined, `join(a, b, half)` from halves of it; b is null beyond the
    end. Places whose run ends after the last value are cut off, but for the first."""
    def doubled(half):
        return lambda m: F.zip_with(m, F.slice(m, half + 1, F.size(m)), lambda a, b: join(a, b, half))

    joined, half = values, 1
    while half < width:
        joined, half = bound(joined, doubled(half)), 2 * half
    return F.slice(joined, 1, F.greatest(F.size(values) - (width - 1), F.least(F.size(values), F.lit(1))))


def _grams(h: Column) -> Column:
    """The hash of each run of GRAM units: the units' hashes, rotated by their distance from the run's end, in an exclusive
    or. A shorter text makes one, whose missing units are 0."""

    def join(a, b, half):
        return F.shiftleft(a, half).bitwiseOR(F.shiftrightunsigned(a, 64 - half)).bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")))

    return _halves(h, GRAM, join)


def _minima(g: Column) -> Column:
    def number(x, i):
        return F.shiftleft(F.shiftrightunsigned(x, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(F.lit(LAST) - i.cast("long"))

    def place(x):
        return (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("int")

    smallest = _halves(F.transform(g, number), WINDOW, lambda a, b, half: F.least(a, b))
    return F.transform(F.array_distinct(smallest), lambda x: F.struct(F.get(g, place(x)).alias("hash"), place(x).alias("position")))


def bound(value: Column, then) -> Column:
    """`then(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def fingerprint(found: Column) -> Column:
    """The kept hashes in order, as hexadecimal text joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.lower(F.hex(x["hash"]))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared part of all distinct kept hashes; two empty fingerprints are alike."""
    x, y = (F.array_distinct(c["hash"]) for c in (a, b))
    return bound(
        F.struct(x.alias("x"), y.alias("y")),
        lambda s: bound(
            F.struct(F.size(F.array_intersect(s["x"], s["y"])).alias("n"), (F.size(s["x"]) + F.size(s["y"])).alias("m")),
            lambda c: F.when(c["m"] == 0, 1.0).otherwise(c["n"] / (c["m"] - c["n"])),
        ),
    )


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, kept (hash, position), fingerprint, positions (first unit of each kept run, from 0).

    Null texts count as empty; a text without words has an empty fingerprint, one with fewer than GRAM units
    one hash of them all. An empty table gives an empty result; other columns are dropped.
    """
    found = whole_texts(docs, id_col, text_col).withColumn("kept", kept(F.col("text")))
    return found.withColumn("fingerprint", fingerprint(F.col("kept"))).withColumn("positions", F.col("kept")["position"])


def _blocks(docs: DataFrame, place: Column) -> Column:
    """The block of ids that each row is in; blocks have about equal numbers of rows, however ids lie."""
    blocks = TASK_BLOCKS * parallelism(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx(place, [k / blocks for k in range(1, blocks)], 10 * blocks).alias("cuts")).first()["cuts"]
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts or [])))).cast("array<bigint>"), lambda c: c <= place))


def with_next(docs: DataFrame, values: list[str]) -> DataFrame:
    """The rows, each with `next_<value>` of the row that follows by descending doc_id; after the last, the first.

    Rows are ordered within blocks of ids; a block's last row takes its values from the largest row of the next
    block that has rows. Rows of one id follow each other by their values; a null id comes after all others.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    blocked = docs.withColumn("place", key).withColumn("block", _blocks(docs, key))
    # One row per block, written so that its size is known to the join with whole rows.
    down = Window.orderBy(F.desc("block"))
    chain = materialise(blocked.groupBy("block").agg(F.max("place").alias("top")).select(
        F.coalesce(F.lag("block").over(Window.orderBy("block")), F.first("block").over(down)).alias("next_block"), "block", "top"
    ), "blocks")
    tops = blocked.join(chain.select("block", F.col("top").alias("place")), ["block", "place"], "left_semi")
    heads = tops.groupBy("block").agg(F.max(F.struct(*values)).alias("after")).withColumnRenamed("block", "next_block")
    after = materialise(chain.select("block", "next_block").join(heads, "next_block").select("block", "after"), "heads")
    order = Window.partitionBy("block").orderBy(F.desc("place"), *[F.desc(v) for v in values])
    # What follows costs far more than the bytes that move, so tasks are not put together by these.
    moved = blocked.repartition(BLOCK_TASKS * parallelism(docs.sparkSession), "block")
    led = moved.withColumn("following", F.lead(F.struct(*values)).over(order)).join(after, "block")
    return led.select("*", *[F.coalesce(F.col("following")[v], F.col("after")[v]).alias(f"next_{v}") for v in values]).drop(
        "place", "block", "following", "after"
    )


def edited(text: Column, other: Column) -> Column:
    """The text whose last half is replaced by as many first code points of the other (or all)."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def compared_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its edited text (last half from the next document by descending id), the fingerprints of
    both, and how alike its fingerprint is to the edited text's and to the next document's.

    Null texts count as empty; two empty fingerprints are alike. Rows of one id follow each other by their texts, a null
    id comes after all others, and a single row is its own next one. An empty table gives an empty result; other columns
    are dropped.
    """
    rows = with_next(whole_texts(docs, id_col, text_col), ["text"])
    changed = rows.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    # Fingerprints are made after the rows have moved: they would add more to the shuffle than they cost to make.
    changed = changed.select(
        "doc_id", "text", "edited_text", kept(F.col("text")).alias("kept"), kept(F.col("next_text")).alias("next_kept"),
        kept(F.col("edited_text")).alias("edited_kept"),
    )
    return changed.select(
        "doc_id", "text", "edited_text", fingerprint(F.col("kept")).alias("fingerprint"),
        fingerprint(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"), likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
        F.col("kept")["position"].alias("positions"),
    )
