"""Mixing sources to target weights: tokens per source, repetition rates, whole and hash-drawn copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.sources.workspace import materialise

# Weights by a source's place, share of all tokens and limit, both in halves.
WEIGHTS = (3, 1, 2)
BUDGET_HALVES, LIMIT = 3, 2
SEED = 7
SPACE = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; 0 for null."""
    pieces = F.size(F.split(text, f"{SPACE}+", -1))
    outer = text.rlike(f"^{SPACE}").cast("int") + F.substring(text, -1, 1).rlike(SPACE).cast("int")
    return F.when(F.length(text) > 0, pieces - outer).otherwise(0).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key only."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def _placed(sources: DataFrame) -> DataFrame:
    """The rows with their `place` by (missing, source), from 0: sorted in ranges, each of which begins where the ones
    before end."""
    numbered = sources.repartitionByRange("missing", "source").sortWithinPartitions("missing", "source").withColumn("at", F.monotonically_increasing_id())
    rows = materialise(numbered.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    # One row for each task.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(offsets), "part").withColumn("place", F.col("before") + F.col("at")).drop("part", "at", "before")


def rates(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources by code point, null last, weigh 3, 1, 2, repeating; together they get 1.5 times all words. A source
    stops at twice its size, and what that leaves is shared again by weight until none is above.
    """
    sources = sized.groupBy("source").agg(F.sum("size").cast("decimal(38,0)").alias("source_size"))
    keyed = materialise(sources.withColumn("missing", F.col("source").isNull()), "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    placed = materialise(
        _placed(keyed).select("source", "source_size", weight.cast("decimal(38,0)").alias("weight"), F.lit(False).alias("full")),
        "sources",
    )
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    while True:
        room = placed.agg(
            F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))), F.lit(0)).alias("used"),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0)).alias("weights"),
            F.count(F.when(F.col("full"), 1)).alias("stopped"),
        ).first()
        # Halves of a word are left for the sources below their limit, by weight.
        left = int(BUDGET_HALVES * total - 2 * LIMIT * room["used"])
        weights = int(room["weights"])
        above = F.col("weight") * F.lit(left).cast("decimal(38,0)") > F.col("source_size") * F.lit(2 * LIMIT * weights).cast("decimal(38,0)")
        now = placed.withColumn("full", F.col("full") | above)
        if now.where("full").count() == room["stopped"]:
            break
        placed = now
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(max(1, 2 * weights)))
    return placed.select(
        "source", F.col("source_size").cast("long").alias("source_size"),
        F.when(F.col("full"), (F.col("source_size") * LIMIT).cast("double")).otherwise(share).alias("target"),
    )


def copies(rate: Column, seed: int, key: Column) -> Column:
    """floor(rate), and one more where the key's number is below the fraction."""
    return F.floor(rate) + F.when(uniform(seed, key) < rate - F.floor(rate), 1).otherwise(0)


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, copies, taken (words, repeats counted).

    Null texts have size 0; a null source is a source of its own, last in order. Sources without words get a
    target of 0. Rows that repeat a doc_id draw alike. An empty table gives an empty result; other columns are
    ignored. Reruns agree: the draw depends on seed and doc_id only.
    """
    sized = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")), "sized")
    table = materialise(rates(sized.select("source", "size")), "rates")
    joined = sized.alias("d").join(table.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return joined.select("doc_id", "size", "source_size", "target", copies(_rate(), seed, F.col("doc_id")).cast("long").alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies")
    )


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns, whatever their names.

    Null texts have size 0 and a null source is a source of its own, last in order; rows that repeat a doc_id draw alike.
    An empty table gives an empty result.
    """
    sized = docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    table = materialise(rates(sized), "rates").select(F.col("source").alias("kin_source"), "source_size", "target")
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    joined = docs.alias("d").join(table.alias("s"), F.col("d.source").cast("string").eqNullSafe(F.col("s.kin_source")))
    times = copies(F.when(F.col("s.source_size") > 0, F.col("s.target") / F.col("s.source_size")).otherwise(0.0), seed, F.col("d.doc_id"))
    return joined.withColumn("kin_times", times.cast("int")).where("kin_times > 0").withColumn(
        "kin_copy", F.explode(F.sequence(F.lit(1), F.col("kin_times")))
    ).select(*columns)
