"""Analytics over posterior draws: long form, means, intervals, stacked tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.columns import label, ordinal, require
from kinfold.functions.values import CATEGORIES, COMMON, HDI_PROB, MODELS, STACKED_MODELS
from kinfold.operators.ranks import dense_codes, ranked

SERIES = ["model", "parameter", "category"]


def explode_draws(vectors: DataFrame, hyper: DataFrame) -> DataFrame:
    """Array-valued parameters as rows (model, chain, draw, parameter, k, value)."""
    frac = vectors.select(
        "model", "chain", "draw", F.concat(F.lit("frac"), F.col("key")).alias("parameter"),
        F.posexplode("frac").alias("k", "value"),
    )
    alpha = hyper.select(
        "model", "chain", "draw", F.lit("hyper_alpha").alias("parameter"), F.posexplode("hyper_alpha").alias("k", "value")
    )
    return frac.unionByName(alpha)


def long_draws(vectors: DataFrame, hyper: DataFrame) -> DataFrame:
    """All draws as (model, chain, draw, parameter, category, value).

    Concentrations and the rate belong to no single type: one row each, under 'common'.
    """
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    typed = explode_draws(vectors, hyper).select(
        "model", "chain", "draw", "parameter", F.element_at(names, F.col("k") + 1).alias("category"), "value"
    )
    conc = vectors.select(
        "model", "chain", "draw", F.concat(F.lit("conc"), F.col("key")).alias("parameter"),
        F.lit(COMMON).alias("category"), F.col("conc").alias("value"),
    )
    rate = hyper.select(
        "model", "chain", "draw", F.lit("hyper_lambda").alias("parameter"),
        F.lit(COMMON).alias("category"), F.col("hyper_lambda").alias("value"),
    )
    return typed.unionByName(conc).unionByName(rate)


def vectors_of(draws: DataFrame) -> DataFrame:
    """Back from long rows to (model, key, chain, draw, frac, conc)."""
    require(draws, *SERIES, "chain", "draw", "value")
    block = F.substring("parameter", 1, 4)
    rows = draws.where(block.isin("frac", "conc")).withColumn("key", F.expr("substring(parameter, 5)"))
    return rows.groupBy("model", "key", "chain", "draw").agg(
        F.array(*[F.max(F.when(F.col("category") == c, F.col("value"))) for c in CATEGORIES]).alias("frac"),
        F.max(F.when(F.col("category") == COMMON, F.col("value"))).alias("conc"),
    )


def posterior_means(draws: DataFrame) -> DataFrame:
    return draws.groupBy(*SERIES).agg(F.avg("value").alias("pmean"))


def hdi(draws: DataFrame, prob: float = HDI_PROB) -> DataFrame:
    """Shortest interval holding `prob` of each series (Chen & Shao 1999), the lowest on ties.

    Rows are (series, hdi, boundary) with hdi 'lower' or 'higher'. Each order statistic
    finds its partner by an equi-join on its rank, so no task holds a whole series.
    """
    placed = ranked(draws.select(*SERIES, "chain", "draw", "value"), SERIES, ["value", "chain", "draw"], "hdi")
    span = F.floor(F.lit(prob) * F.col("total"))
    low = placed.select(*SERIES, F.col("rank0").alias("at"), (F.col("rank0") + span).alias("rank0"), F.col("value").alias("lower"))
    high = placed.select(*SERIES, "rank0", F.col("value").alias("higher"))
    best = (
        low.join(high, [*SERIES, "rank0"])
        .groupBy(*SERIES)
        .agg(F.min_by(F.struct("lower", "higher"), F.struct(F.col("higher") - F.col("lower"), F.col("at"))).alias("b"))
    )
    return best.select(*SERIES, "b.lower", "b.higher").unpivot(SERIES, ["lower", "higher"], "hdi", "boundary")


def hdi_in_place(draws: DataFrame, prob: float = HDI_PROB) -> DataFrame:
    """`hdi` by a window over each series, for draws that are dealt out by series already, as in a snapshot.

    All series of a model have the same number of draws. A task sorts the series it has, on disk where they do not fit;
    no row leaves it but the ends of the interval.
    """
    sizes = draws.groupBy("model").agg(((F.max("chain") + 1).cast("long") * (F.max("draw") + 1)).alias("n")).collect()
    series = Window.partitionBy(*SERIES).orderBy("value", "chain", "draw")
    parts = []
    for r in sizes:
        ends = draws.where(F.col("model") == r["model"]).select(
            *SERIES, F.row_number().over(series).alias("at"), F.col("value").alias("lower"),
            F.lead("value", math.floor(prob * r["n"])).over(series).alias("higher"),
        )
        parts.append(ends.where(F.col("higher").isNotNull()).groupBy(*SERIES).agg(
            F.min_by(F.struct("lower", "higher"), F.struct(F.col("higher") - F.col("lower"), F.col("at"))).alias("b")
        ))
    best = reduce(DataFrame.unionByName, parts)
    return best.select(*SERIES, "b.lower", "b.higher").unpivot(SERIES, ["lower", "higher"], "hdi", "boundary")


def hdi_wide(intervals: DataFrame) -> DataFrame:
    return (
        intervals.groupBy(*SERIES).pivot("hdi", ["lower", "higher"]).agg(F.first("boundary"))
        .withColumnsRenamed({"lower": "lower_bound", "higher": "higher_bound"})
    )


def posterior_table(draws: DataFrame, prob: float = HDI_PROB) -> DataFrame:
    """Intervals left-joined with means, in category order; a category outside the list has no order."""
    out = hdi_wide(hdi(draws, prob)).join(posterior_means(draws), SERIES, "left")
    order = ordinal(F.col("category"), [*CATEGORIES, COMMON])
    return out.withColumn("category_order", order).orderBy("category_order", "model", "parameter")


def split_sex(table: DataFrame) -> DataFrame:
    """Sex of a parameter by its name, and the name without it.

    'female' contains 'male', so it is tested first; '_female' is cut before '_male'.
    """
    name = F.col("parameter")
    sex = F.when(name.contains("female"), "Female").when(name.contains("male"), "Male")
    bare = F.replace(F.replace(name, F.lit("_female")), F.lit("_male"))
    return table.withColumn("sex", sex).withColumn("parameter", bare)


def stack_models(table: DataFrame, names: DataFrame) -> DataFrame:
    """Posterior tables of all models under one set of names, with an id per drawn line.

    `names` lists the parameter names in order (parameter, parameter_order).
    """
    sexed = split_sex(table.where(F.col("model") == "Sex"))
    plain = table.where(F.col("model") != "Sex").withColumn("sex", F.lit(None).cast("string"))
    variant = F.when(F.col("sex").isNull(), "Sex (Common)").otherwise(F.concat(F.lit("Sex ("), F.col("sex"), F.lit(")")))
    stacked = plain.unionByName(sexed.withColumn("model", variant))
    return (
        stacked.join(names, "parameter", "left")
        .withColumn("category_order", ordinal(F.col("category"), [*CATEGORIES, COMMON]))
        .withColumn("model_order", ordinal(F.col("model"), STACKED_MODELS))
        .withColumn("estimate_id", F.concat("parameter", F.lit("_"), "model"))
    )


def parameter_dim(respondents: DataFrame) -> DataFrame:
    """Every parameter name of the three models with its block, group and sex."""
    villages = respondents.select("group_id").where(F.col("group_id").isNotNull()).distinct()
    blocks = F.explode(F.array(F.lit("frac"), F.lit("conc"))).alias("block")
    sexes = F.array(F.lit(None).cast("string"), F.lit("female"), F.lit("male"))
    by_village = (
        villages.select("group_id", blocks).withColumn("sex", F.explode(sexes))
        .select(
            F.when(F.col("sex").isNull(), "Extended").otherwise("Sex").alias("model"),
            F.concat("block", F.lit("_vill_"), "group_id", F.coalesce(F.concat(F.lit("_"), "sex"), F.lit(""))).alias("parameter"),
            "block", "group_id", "sex",
        )
    )
    spark = respondents.sparkSession
    shared = spark.createDataFrame(
        [("Baseline", "frac", "frac"), ("Baseline", "conc", "conc")]
        + [(m, h, "hyper") for m in MODELS for h in ("hyper_alpha", "hyper_lambda")],
        "model string, parameter string, block string",
    )
    return by_village.unionByName(shared, allowMissingColumns=True)


def parameter_order(respondents: DataFrame) -> DataFrame:
    """(parameter, parameter_order): hyperparameters, frac, village fracs, conc, village concs."""
    codes = dense_codes(respondents.where(F.col("group_id").isNotNull()), "group_id")
    spark = respondents.sparkSession
    fixed = spark.createDataFrame(
        [("hyper_alpha", 0), ("hyper_lambda", 1), ("frac", 2)], "parameter string, parameter_order long"
    )
    conc = codes.agg((F.count(F.lit(1)) + 3).alias("parameter_order")).select(F.lit("conc").alias("parameter"), "parameter_order")
    frac_vill = codes.select(F.concat(F.lit("frac_vill_"), "group_id").alias("parameter"), (F.col("code") + 3).alias("parameter_order"))
    conc_vill = spark.sql(
        "SELECT concat('conc_vill_', group_id) AS parameter, code + 4 + (SELECT count(*) FROM {codes}) AS parameter_order FROM {codes}",
        codes=codes,
    )
    return fixed.unionByName(conc).unionByName(frac_vill).unionByName(conc_vill)


def recode(column: str, labels: dict):
    return F.coalesce(label(F.col(column), labels), F.col(column))
