"""Dirichlet-Multinomial likelihood, its sufficient statistics and priors.

A model is a parameter key per respondent: '' for the baseline, '_vill_<group>' for
the extended and '_vill_<group>_<sex>' for the sex model; `frac<key>` and `conc<key>`
are the parameter names. `vectors` frames hold one row per (model, key, chain, draw)
with the eight proportions `frac` and the concentration `conc`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.columns import array_sum, log_factorial, log_gamma, log_rising, require
from kinfold.functions.values import ALPHA_MU, ALPHA_SIGMA, CATEGORIES, LAMBDA_RATE, LAMBDA_SHAPE, MODELS
from kinfold.sources.workspace import materialise, parallelism


def model_key(model: str):
    """Parameter key of a respondent under a model. Female is 1; anything else takes the male block."""
    village = F.concat(F.lit("_vill_"), F.col("group_id"))
    if model == "Baseline":
        return F.lit("")
    if model == "Extended":
        return village
    if model == "Sex":
        return F.concat(village, F.when(F.col("female") == 1, "_female").otherwise("_male"))
    raise ValueError(f"unknown model specification: {model!r}")


def with_models(df: DataFrame, models=MODELS) -> DataFrame:
    """Each row once per model, with its parameter key."""
    keys = F.array(*[F.struct(F.lit(m).alias("model"), model_key(m).alias("key")) for m in models])
    return df.withColumn("__m", F.explode(keys)).select("__m.*", *df.columns)


def patterns(sample: DataFrame) -> DataFrame:
    """Distinct (group, sex, count vector) with its number of respondents.

    Likelihood, cross-validation and model weights depend on respondents only through
    these, so they cost as many rows as there are patterns.
    """
    require(sample, "group_id", "female", "lender_ij", *CATEGORIES)
    return sample.groupBy("group_id", "female", "lender_ij", *CATEGORIES).agg(
        F.count(F.lit(1)).alias("respondents")
    )


def pattern_id():
    """Text key of a pattern, from every column that patterns are grouped by; null is written as a sign no value has."""
    columns = ["group_id", "female", "lender_ij", *CATEGORIES]
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])


def group_proportions(sample: DataFrame, models=MODELS) -> DataFrame:
    """Pooled share of each type under every parameter key."""
    sums = with_models(sample, models).groupBy("model", "key").agg(
        F.sum("lender_ij").alias("lenders"), *[F.sum(c).alias(c) for c in CATEGORIES]
    )
    return sums.unpivot(["model", "key", "lenders"], list(CATEGORIES), "category", "edges").withColumn(
        "proportion", F.col("edges") / F.col("lenders")
    )


def tail_counts(sample: DataFrame, models=MODELS) -> DataFrame:
    """Per key: rows with y > j for each type, and with n > j (category null), j = 0, 1, ...

    The likelihood is a function of these alone. Rows are first counted per value, and
    each run between two neighbouring values is expanded once, so the output has
    max(y) rows per key and type whatever the number of respondents.
    """
    columns = ["lender_ij", *CATEGORIES]
    counted = (
        with_models(patterns(sample), models)
        .unpivot(["model", "key", "respondents"], columns, "name", "y")
        .where(F.col("y") > 0)
        .groupBy("model", "key", "name", "y").agg(F.sum("respondents").alias("c"))
    )
    cell = Window.partitionBy("model", "key", "name")
    up = cell.orderBy("y")
    runs = counted.select(
        "model", "key",
        F.when(F.col("name") != "lender_ij", F.col("name")).alias("category"),
        F.coalesce(F.lag("y").over(up), F.lit(0)).alias("lo"),
        F.col("y").alias("hi"),
        F.sum("c").over(cell.orderBy(F.desc("y"))).alias("n_above"),
    )
    return runs.select(
        "model", "key", "category", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("j"), "n_above"
    )


def counts():
    return F.array(*[F.col(c) for c in CATEGORIES])


def pmf_constant():
    """ln n! - sum ln y!, free of parameters."""
    return log_factorial(F.col("lender_ij")) - array_sum(F.transform(counts(), log_factorial))


def log_likelihood(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Log pmf `ll` of every row under every draw of its parameter key.

    `rows` has model, key and the counts. The parameter side joins on (model, key);
    `spread_join` deals the rows of a hot key over many tasks.
    """
    require(rows, "model", "key", "lender_ij", *CATEGORIES)
    prepared = rows.withColumn("__const", pmf_constant()).withColumn("__y", counts())
    joined = spread_join(prepared, pack_draws(vectors))
    conc = F.col("conc")
    types = F.zip_with("frac", "__y", lambda f, y: log_rising(f * conc, y))
    total = conc * array_sum(F.col("frac"))
    return joined.withColumn("__total", total).withColumn(
        "ll", F.col("__const") + array_sum(types) - log_rising(F.col("__total"), F.col("lender_ij"))
    ).drop("__const", "__y", "__total", "frac", "conc")


PACK = 32
# Vectors that are broadcast together.
BROADCAST_ROWS = 400_000
# A key with more rows than this, and more than this share of all rows, is cut into parts of that size.
PART_ROWS, PART_SHARE = 4096, 10_000


def pack_draws(vectors: DataFrame) -> DataFrame:
    """Draws of a key in arrays of PACK per chain, so a join moves one row per pack."""
    draw = F.struct("chain", "draw", "frac", "conc")
    return vectors.groupBy("model", "key", F.expr(f"draw DIV {PACK}").alias("pack")).agg(
        F.collect_list(draw).alias("draws"), F.count(F.lit(1)).alias("n_draws")
    )


def spread_join(rows: DataFrame, packs: DataFrame) -> DataFrame:
    """Rows x draws of their key, whatever share of the rows one key holds.

    Models are taken by their measured number of vectors, the smallest first: as long as these fit a broadcast, the
    model's rows are dealt evenly over all tasks; the others are shuffled.
    """
    sizes = sorted((r["n"], r["model"]) for r in packs.groupBy("model").agg(F.sum("n_draws").alias("n")).collect())
    sent, together = [], 0
    for n, model in sizes:
        if together + n <= BROADCAST_ROWS:
            sent.append(model)
            together += n
    dealt = [m for _, m in sizes if m not in sent]
    joined = []
    if sent or not dealt:
        chosen = F.col("model").isin(sent)
        joined.append(rows.where(chosen).repartition(parallelism(rows.sparkSession)).join(F.broadcast(packs.where(chosen)), ["model", "key"]))
    if dealt:
        chosen = F.col("model").isin(dealt)
        joined.append(_salted_join(rows.where(chosen), packs.where(chosen)))
    names = [*rows.columns, "draws"]
    whole = reduce(DataFrame.unionByName, [j.select(*names) for j in joined])
    return whole.withColumn("__d", F.explode("draws")).select("__d.*", *rows.columns)


def _salted_join(rows: DataFrame, packs: DataFrame) -> DataFrame:
    """Shuffle on key and pack. A key with many rows is cut into parts by its measured rows; as such a key has more than
    one in PART_SHARE of all rows, their list is short enough to be sent to all tasks."""
    counts = materialise(rows.groupBy("model", "key").agg(F.count(F.lit(1)).alias("n")), "key_rows")
    part = max(PART_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // PART_SHARE)
    hot = counts.where(F.col("n") > part).select("model", "key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    index = packs.groupBy("model").agg(F.max("pack").alias("last"))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    keyed = (
        rows.join(F.broadcast(hot), ["model", "key"], "left").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), parts).cast("int"))
        .join(F.broadcast(index), "model").withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    )
    copies = packs.join(F.broadcast(hot), ["model", "key"], "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return keyed.drop("parts", "last").join(copies.drop("parts"), ["model", "key", "pack", "__salt"])


def log_prior(hyper: DataFrame) -> DataFrame:
    """Log prior density of the hyperparameters: LogNormal alphas and a Gamma rate.

    `hyper` has hyper_alpha (array) and hyper_lambda.
    """
    def log_normal(a):
        z = (F.log(a) - ALPHA_MU) / ALPHA_SIGMA
        return -F.log(a) - math.log(ALPHA_SIGMA * math.sqrt(2 * math.pi)) - z * z / 2

    lam = F.col("hyper_lambda")
    gamma = (
        F.lit(LAMBDA_SHAPE * math.log(LAMBDA_RATE) - math.lgamma(LAMBDA_SHAPE))
        + (LAMBDA_SHAPE - 1) * F.log(lam) - LAMBDA_RATE * lam
    )
    return hyper.withColumn("log_prior_alpha", array_sum(F.transform("hyper_alpha", log_normal))).withColumn(
        "log_prior_lambda", gamma
    )


def parameter_log_prior(vectors: DataFrame, hyper: DataFrame) -> DataFrame:
    """Log prior of every simplex (Dirichlet) and concentration (Exponential) given its draw's hyperparameters."""
    joined = vectors.join(hyper, ["model", "chain", "draw"])
    alpha_total = F.transform(F.array(array_sum(F.col("hyper_alpha"))), log_gamma)[0]
    dirichlet = (
        alpha_total - array_sum(F.transform("hyper_alpha", log_gamma))
        + array_sum(F.zip_with("hyper_alpha", "frac", lambda a, f: (a - 1) * F.log(f)))
    )
    return joined.select(
        "model", "key", "chain", "draw",
        dirichlet.alias("log_prior_frac"),
        (F.log("hyper_lambda") - F.col("hyper_lambda") * F.col("conc")).alias("log_prior_conc"),
        # hyper_lambda integrated out: Lomax; holds for the single concentration of the baseline
        F.when(
            F.col("key") == "",
            F.lit(math.log(LAMBDA_SHAPE) + LAMBDA_SHAPE * math.log(LAMBDA_RATE))
            - (LAMBDA_SHAPE + 1) * F.log(LAMBDA_RATE + F.col("conc")),
        ).alias("log_prior_conc_marginal"),
    )
