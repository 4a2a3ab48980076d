"""Posterior draws that SQL can rebuild: Bayesian-bootstrap weights over the modelled respondents.

Rubin's (1981) Bayesian bootstrap gives every respondent an exponential weight per
draw. Weights are whole numbers taken from md5, so sums are exact in any order and the
same draws come out of any engine and any partitioning. They stand in for sampler
output where results are checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.columns import hash_uniform
from kinfold.functions.values import CATEGORIES, CHAINS, SEED
from kinfold.operators.likelihood import with_models
from kinfold.sources.workspace import materialise, parallelism

UNIT = 2**20
DRAWS = 25


def bootstrap(sample: DataFrame, draws: int = DRAWS, chains: int = CHAINS) -> tuple[DataFrame, DataFrame]:
    """(vectors, hyper): parameters per (model, key, chain, draw), hyperparameters per (model, chain, draw).

    Each frac is the weighted share of a type with one weight unit added per type, conc
    the weighted mean number of lenders; the last chain of the extended model's first
    village in text order ('_vill_0') is shifted, so that one parameter fails R-hat.
    """
    spark = sample.sparkSession
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(chains * draws - 1)),
        lambda s: F.struct(F.floor(s / draws).cast("int").alias("chain"), (s % draws).cast("int").alias("draw")),
    )
    u = hash_uniform(SEED, F.col("chain"), F.col("draw"), F.col("id"))
    weighted = (
        sample.select("id", "group_id", "female", "lender_ij", *CATEGORIES)
        .repartition(parallelism(spark))
        .withColumn("d", F.explode(grid)).select("*", "d.*")
        .withColumn("w", F.floor(-F.log(u + F.lit(2.0**-53)) * UNIT))
    )
    by_sex = weighted.groupBy("group_id", "female", "chain", "draw").agg(
        F.sum("w").alias("w"),
        F.sum(F.col("w") * F.col("lender_ij")).alias("wn"),
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in CATEGORIES],
    )
    keyed = with_models(by_sex).groupBy("model", "key", "chain", "draw").agg(
        F.sum("w").alias("w"), F.sum("wn").alias("wn"), *[F.sum(c).alias(c) for c in CATEGORIES]
    )
    shift = F.when((F.col("key") == "_vill_0") & (F.col("chain") == chains - 1), 1.0).otherwise(0.0)
    total = F.col("wn") + len(CATEGORIES) * UNIT
    vectors = keyed.select(
        "model", "key", "chain", "draw",
        F.array(*[(F.col(c) + UNIT) / total for c in CATEGORIES]).alias("frac"),
        (F.col("wn") / F.col("w") + shift).alias("conc"),
        F.array(*[(F.col(c) + UNIT) / F.col("w") for c in CATEGORIES]).alias("mean_counts"),
        (F.col("w") / F.col("wn")).alias("rate"),
    )
    written = materialise(vectors, "bootstrap")
    base = written.where(F.col("key") == "").select("chain", "draw", F.col("mean_counts").alias("a"), F.col("rate").alias("r"))
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(k + 1)).alias("x")) for k, m in enumerate(("Baseline", "Extended", "Sex"))])
    hyper = base.withColumn("m", F.explode(models)).select(
        "m.model", "chain", "draw",
        F.transform("a", lambda a: a * F.col("m.x")).alias("hyper_alpha"),
        (F.col("r") * F.col("m.x")).alias("hyper_lambda"),
    )
    return written.select("model", "key", "chain", "draw", "frac", "conc"), hyper
