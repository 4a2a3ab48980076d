"""Views that give the driver's tables the survey's shape, so every operator can be checked in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.operators.network import composition, modelled, tied_dyads
from kinfold.sources.survey import respondents as join_respondents
from kinfold.sources.workspace import materialise

# Members of a group are numbered in key order inside key blocks of this many keys,
# plus the number of members in earlier blocks: no window spans a whole group.
BLOCK = 65536

# Relation kind by the first character of the order priority.
KINDS = {"1": "lender", "2": "friend", "3": "family", "4": "solver", "5": "speak"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed_members(spark, sf_dir) -> DataFrame:
    """Customers with their position in, and the size of, their nation."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment", F.expr(f"c_custkey DIV {BLOCK}").alias("block")
    )
    blocks = c.groupBy("c_nationkey", "block").agg(F.count(F.lit(1)).alias("n"))
    by_nation = Window.partitionBy("c_nationkey")
    earlier = by_nation.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "c_nationkey", "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
        F.sum("n").over(by_nation).alias("gsz"),
    )
    in_block = Window.partitionBy("c_nationkey", "block").orderBy("c_custkey")
    return (
        c.withColumn("rn", F.row_number().over(in_block) - 1)
        .join(offsets, ["c_nationkey", "block"])
        .select("c_custkey", "c_nationkey", "c_mktsegment", (F.col("offset") + F.col("rn")).alias("pos"), "gsz")
    )


class Survey:
    """The survey tables of one data folder. People and ties are written once and read by every later stage."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def primary(self) -> DataFrame:
        c = table(self.spark, self.sf_dir, "customer")
        key = F.col("c_custkey")
        unknown = (F.col("c_mktsegment") == "MACHINERY") & (key % 4 == 0)
        female = F.when(unknown, F.lit(None).cast("int")).otherwise(F.when(key % 2 == 0, 1).otherwise(0))
        return c.select(
            key.cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("group_id"), female.alias("female")
        )

    @cached_property
    def members(self) -> DataFrame:
        return materialise(placed_members(self.spark, self.sf_dir), "members")

    def secondary(self) -> DataFrame:
        nation = table(self.spark, self.sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        return self.members.join(nation, "c_nationkey").select(
            F.col("c_custkey").cast("string").alias("id"),
            F.col("c_nationkey").cast("string").alias("group_id"),
            F.col("n_name").alias("group_txt"),
            F.expr("pos DIV 3").cast("string").alias("hh_id"),
        )

    @cached_property
    def respondents(self) -> DataFrame:
        return materialise(join_respondents(self.primary(), self.secondary()), "respondents")

    @cached_property
    def nominations(self) -> DataFrame:
        """Ties of every kind with their multiplicity `n`.

        Orders are counted per (customer, offset, kind) first, so a customer with any
        share of the orders brings at most twenty rows into the joins.
        """
        kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
        counted = (
            table(self.spark, self.sf_dir, "orders")
            .groupBy(
                "o_custkey",
                (F.col("o_orderkey") % 4).alias("turn"),
                kind[F.substring("o_orderpriority", 1, 1)].alias("type"),
            )
            .agg(F.count(F.lit(1)).alias("n"))
        )
        giver = self.members.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.col("pos").alias("i_pos"), "gsz")
        taker = self.members.select("c_nationkey", "pos", F.col("c_custkey").alias("j"))
        turn = F.col("turn")
        offset = (
            F.when(turn == 0, F.lit(1)).when(turn == 1, F.lit(2))
            .when(turn == 2, F.col("gsz") - 1).otherwise(F.col("gsz") - 2)
        )
        return (
            counted.join(giver, "o_custkey")
            .withColumn("pos", F.pmod(F.col("i_pos") + offset, F.col("gsz")))
            .join(taker, ["c_nationkey", "pos"])
            .groupBy(
                F.col("c_nationkey").cast("string").alias("group_id"),
                F.col("o_custkey").cast("string").alias("i_id"),
                F.col("j").cast("string").alias("j_id"),
                "type",
            )
            .agg(F.sum("n").alias("n"))
        )

    def dyads(self, dedupe: bool = True) -> DataFrame:
        return tied_dyads(self.nominations, self.respondents, dedupe)

    def composed(self, dedupe: bool = True) -> DataFrame:
        return composition(self.dyads(dedupe), self.respondents)

    def sample(self) -> DataFrame:
        return modelled(self.composed())
