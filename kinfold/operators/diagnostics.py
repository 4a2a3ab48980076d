"""Convergence diagnostics of posterior draws.

Draws are long rows (model, parameter, category, chain, draw, value) with draws
numbered 0, 1, ... in every chain and equally many in all chains of a model. Every
chain is split into halves; an odd middle draw belongs to neither.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.columns import label, normal_quantile
from kinfold.functions.values import MAX_RHAT, MIN_ESS, SUMMARY_HDI_PROB
from kinfold.operators.draws import SERIES, hdi, hdi_wide
from kinfold.operators.ranks import average_ranks, ranked
from kinfold.sources.workspace import materialise

# Lags worked out at a time, and length of the pieces a half chain is cut into: where all lags are asked for, and first
# of all where a sequence may end early.
BLOCK, FIRST_LAGS = 4096, 64
TAIL_PROBS = (0.05, 0.95)


def chain_lengths(draws: DataFrame) -> dict:
    """Draws per chain of each model."""
    return {r["model"]: int(r["n"]) for r in draws.groupBy("model").agg((F.max("draw") + 1).alias("n")).collect()}


def halves(draws: DataFrame, lengths: dict) -> DataFrame:
    """Rows with their half chain `half`, position `t` in it and its length `h`."""
    n = label(F.col("model"), lengths)
    h = label(F.col("model"), {m: k // 2 for m, k in lengths.items()})
    second = F.col("draw") >= n - h
    return (
        draws.withColumn("h", h)
        .where((F.col("draw") < F.col("h")) | second)
        .withColumn("half", (2 * F.col("chain") + second.cast("int")).cast("int"))
        .withColumn("t", (F.col("draw") - F.when(second, n - h).otherwise(0)).cast("long"))
    )


def _split_rhat(rows: DataFrame, keys, value: str) -> DataFrame:
    per_half = rows.groupBy(*keys, "half", "h").agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    within, between, h = F.col("w"), F.col("b"), F.col("h")
    return (
        per_half.groupBy(*keys, "h").agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"))
        .withColumn("rhat", F.when(within > 0, F.sqrt(((h - 1) / h * within + between) / within)))
        .drop("w", "b", "h")
    )


def rhat_split(draws: DataFrame) -> DataFrame:
    """Split R-hat on the values themselves."""
    return _split_rhat(halves(draws, chain_lengths(draws)), SERIES, "value")


def rank_scores(rows: DataFrame, keys, value: str) -> DataFrame:
    """Normal scores `z` of average ranks within the keys; also `rank0` and `total`."""
    placed = average_ranks(rows, keys, value, ["chain", "draw"])
    p = (F.col("avg_rank") - 0.375) / (F.col("total") + 0.25)
    return placed.withColumn("p", p).withColumn("z", normal_quantile(F.col("p"))).drop("p", "avg_rank")


def order_statistic_mean(placed: DataFrame, value="value") -> DataFrame:
    """Median of each series from ranked rows: the mean of the two middle values."""
    middle = F.col("rank0").isin(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))
    return placed.where(middle).groupBy(*SERIES).agg(((F.min(value) + F.max(value)) / 2).alias("median"))


def bulk_and_folded(draws: DataFrame, lengths: dict) -> tuple[DataFrame, DataFrame]:
    """Scores of the split draws, and of their distances from the median (Vehtari et al. 2021)."""
    rows = halves(draws, lengths)
    bulk = rank_scores(rows, SERIES, "value")
    centred = bulk.drop("z", "rank0", "total").join(order_statistic_mean(bulk), SERIES)
    folded = rank_scores(centred.withColumn("distance", F.abs(F.col("value") - F.col("median"))), SERIES, "distance")
    return bulk, folded


def rhat_rank(draws: DataFrame, scores=None) -> DataFrame:
    """The larger of the rank-normalised split R-hat of the draws and of their folded form."""
    bulk, folded = scores or bulk_and_folded(draws, chain_lengths(draws))
    a = _split_rhat(bulk, SERIES, "z").withColumnRenamed("rhat", "rhat_bulk")
    b = _split_rhat(folded, SERIES, "z").withColumnRenamed("rhat", "rhat_folded")
    return a.join(b, SERIES).withColumn("rhat", F.greatest("rhat_bulk", "rhat_folded"))


def _lag_products(left: pd.Series, right: pd.Series) -> pd.Series:
    """Per row: sum_i left[i] right[i + k] for k = 0 .. len(right) - 1."""

    def one(x, y):
        if len(x) == 0 or len(y) == 0:
            return np.zeros(0)
        size = len(x) + len(y)
        return np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)[: len(y)]

    return pd.Series([one(x, y) for x, y in zip(left, right)])


def _lag_sums(centred: DataFrame, keys, offset: int, block: int) -> DataFrame:
    """Sums of products at lags [offset*block, (offset+1)*block) for every half chain.

    A half chain is cut into pieces of `block` draws. A piece meets the two pieces that
    hold its partners at these lags, so an array has at most 2*block values whatever the
    length of the chain.
    """
    piece = F.floor(F.col("t") / block)
    roles = F.array(
        F.struct(piece.alias("b"), F.lit(True).alias("left")),
        F.struct((piece - offset).alias("b"), F.lit(False).alias("left")),
        F.struct((piece - offset - 1).alias("b"), F.lit(False).alias("left")),
    )
    point = F.struct("t", "x")
    pieces = (
        centred.withColumn("r", F.explode(roles)).where(F.col("r.b") >= 0)
        .groupBy(*keys, "half", "h", "r.b")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("r.left"), point))).alias("left"),
            F.sort_array(F.collect_list(F.when(~F.col("r.left"), point))).alias("right"),
        )
    )
    lag_products = F.pandas_udf(_lag_products, "array<double>")
    products = pieces.select(
        *keys, "half", "h",
        F.posexplode(lag_products(F.transform("left", lambda p: p["x"]), F.transform("right", lambda p: p["x"]))).alias("k", "s"),
    )
    return (
        products.where(F.col("k") < block)
        .groupBy(*keys, "half", "h", (F.col("k") + offset * block).cast("long").alias("lag"))
        .agg(F.sum("s").alias("s"))
    )


def autocovariance(rows: DataFrame, keys, value="x", offset: int = 0, block: int = BLOCK) -> DataFrame:
    """Autocovariance per half chain and lag, divided by the full length."""
    means = rows.groupBy(*keys, "half").agg(F.avg(value).alias("__m"))
    centred = rows.join(means, [*keys, "half"]).withColumn("x", F.col(value) - F.col("__m"))
    sums = _lag_sums(centred.select(*keys, "half", "h", "t", "x"), keys, offset, block)
    return sums.select(*keys, "half", "h", "lag", (F.col("s") / F.col("h")).alias("acov")).where(F.col("lag") < F.col("h"))


def _mean_acov(rows, keys, offset, block):
    acov = autocovariance(rows, keys, offset=offset, block=block)
    return acov.groupBy(*keys, "h", "lag").agg(F.avg("acov").alias("acov"))


def _geyer(acov: DataFrame, moments: DataFrame, keys) -> DataFrame:
    """Geyer's initial monotone sequence over some lags: the effective size where it ends there.

    `moments` has a row for each series that is open, with the sum `s` of its sequence so far and its smallest term
    `low`; the result has them after these lags, with `ess` null where more are needed.
    """
    h, var_plus = F.col("h"), F.col("acov0") + F.col("between")
    rho = F.when(F.col("lag") == 0, 1.0).otherwise(1 - (F.col("acov0") * h / (h - 1) - F.col("acov")) / var_plus)
    state = ["h", "n_halves", "between", "acov0", "s", "low"]
    pairs = (
        acov.join(moments, [*keys, "h"])
        .groupBy(*keys, *state, F.expr("lag DIV 2").alias("k"))
        .agg(
            F.max(F.when(F.col("lag") % 2 == 0, rho)).alias("even"),
            F.sum(rho).alias("pair"), F.count(F.lit(1)).alias("n"),
        )
        .withColumn("last", F.ceil((F.col("h") - 2) / 2) - 1)
        .where((F.col("k") <= F.col("last")) & (F.col("n") == 2))
    )
    so_far = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    going = (F.col("term") > 0) & (F.col("k") < F.col("last"))
    sums = (
        pairs.withColumn("term", F.least(F.col("low"), F.min("pair").over(so_far)))
        .groupBy(*keys, *state)
        .agg(
            F.coalesce(F.sum(F.when(going, F.col("term"))), F.lit(0.0)).alias("more"),
            F.min("term").alias("least"), F.min(F.when(~going, F.struct("k", "even"))).alias("stop"),
        )
    )
    size = (F.col("n_halves") * F.col("h")).cast("double")
    total = F.col("s") + F.col("more")
    tau = -1 + 2 * total + F.greatest(F.col("stop.even"), F.lit(0.0))
    ess = F.when(F.col("stop").isNotNull(), size / F.greatest(tau, 1 / F.log10(size)))
    return sums.select(*keys, "h", "n_halves", "between", "acov0", total.alias("s"), F.col("least").alias("low"), ess.alias("ess"))


def effective_size(rows: DataFrame, keys, block: int = FIRST_LAGS) -> DataFrame:
    """Effective sample size of every series of half chains (columns half, t, h, x).

    The first `block` lags are worked out for all series, then as many again, then twice as many each time, for those
    only whose sequence has not ended: a series costs lags in proportion to where it ends, and none is cut short.
    What a series carries on is one row: its moments, the sum of its sequence and the smallest term.
    """
    rows = materialise(rows, "series")
    per_half = rows.groupBy(*keys, "half", "h").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.max("hi") == F.min("lo")
    moments = per_half.groupBy(*keys, "h").agg(
        F.count(F.lit(1)).alias("n_halves"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("between"),
        F.when(flat, F.lit(0.0)).otherwise(F.avg("v")).alias("acov0"),
    ).withColumn("s", F.lit(0.0)).withColumn("low", F.lit(math.inf))
    constant = moments.where("acov0 <= 0").select(*keys, (F.col("n_halves") * F.col("h")).cast("double").alias("ess"))
    found = _geyer(_mean_acov(rows, keys, 0, block), moments.where("acov0 > 0"), keys)
    longest = rows.agg(F.max("h")).first()[0] or 0
    if longest <= block:
        return constant.unionByName(found.select(*keys, "ess"))
    found = materialise(found, "lags")
    out = constant.unionByName(found.where("ess IS NOT NULL").select(*keys, "ess"))
    lags = block
    while lags < longest:
        waiting = materialise(found.where("ess IS NULL").drop("ess"), "waiting")
        if waiting.isEmpty():
            break
        # The block at [lags, 2 lags) is the second one of that size.
        more = _mean_acov(rows.join(waiting.select(*keys), keys, "left_semi"), keys, 1, lags)
        found = materialise(_geyer(more, waiting, keys), "lags")
        out = out.unionByName(found.where("ess IS NOT NULL").select(*keys, "ess"))
        lags *= 2
    return out


def tail_indicators(draws: DataFrame, lengths: dict, placed: DataFrame, probs=TAIL_PROBS) -> DataFrame:
    """Half-chain rows of I(value <= quantile), kind 'q<i>' for each probability."""
    total = F.col("total")
    asked = F.array(*[F.struct(F.lit(f"q{i}").alias("kind"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    at = placed.select(*SERIES, "rank0", "total", "value", F.explode(asked).alias("q")).withColumn("pos", (total - 1) * F.col("q.p"))
    low = F.floor("pos")
    near = at.where((F.col("rank0") >= low) & (F.col("rank0") <= low + 1))
    lo = F.max(F.when(F.col("rank0") == low, F.col("value")))
    hi = F.max(F.when(F.col("rank0") == low + 1, F.col("value")))
    quantiles = near.groupBy(*SERIES, F.col("q.kind").alias("kind"), "pos").agg(lo.alias("lo"), hi.alias("hi"))
    cut = F.col("lo") + (F.coalesce(F.col("hi"), F.col("lo")) - F.col("lo")) * (F.col("pos") - F.floor("pos"))
    rows = halves(draws, lengths).join(quantiles.select(*SERIES, "kind", cut.alias("cut")), SERIES)
    return rows.select(*SERIES, "kind", "half", "h", "t", (F.col("value") <= F.col("cut")).cast("double").alias("x"))


def _all_ranks(draws, lengths, bulk):
    """Ranks over all draws; the split ranks serve when no draw is left out by the split."""
    if all(n % 2 == 0 for n in lengths.values()):
        return bulk
    return ranked(draws.select(*SERIES, "chain", "draw", "value"), SERIES, ["value", "chain", "draw"])


def ess_bulk(draws: DataFrame) -> DataFrame:
    """Effective size of the rank-normalised draws."""
    rows = rank_scores(halves(draws, chain_lengths(draws)), SERIES, "value")
    return effective_size(rows.select(*SERIES, "half", "h", "t", F.col("z").alias("x")), SERIES).withColumnRenamed("ess", "ess_bulk")


def ess_tail(draws: DataFrame, probs=TAIL_PROBS) -> DataFrame:
    """The smallest effective size of the indicators at the tail quantiles."""
    lengths = chain_lengths(draws)
    placed = ranked(draws.select(*SERIES, "chain", "draw", "value"), SERIES, ["value", "chain", "draw"])
    rows = tail_indicators(draws, lengths, placed, probs)
    return effective_size(rows, [*SERIES, "kind"]).groupBy(*SERIES).agg(F.min("ess").alias("ess_tail"))


def relative_efficiency(draws: DataFrame) -> dict:
    """Mean effective size of a model's series over its number of draws, per model."""
    rows = halves(draws, chain_lengths(draws)).withColumn("x", F.col("value"))
    sizes = effective_size(rows.select(*SERIES, "half", "h", "t", "x"), SERIES).groupBy("model").agg(F.avg("ess").alias("e"))
    drawn = draws.groupBy("model").agg(F.countDistinct("chain", "draw").alias("n"))
    return {r["model"]: r["e"] / r["n"] for r in sizes.join(drawn, "model").collect()}


def summary(draws: DataFrame, prob: float = SUMMARY_HDI_PROB, probs=TAIL_PROBS) -> DataFrame:
    """Mean, sd, interval, Monte Carlo errors, effective sizes and R-hat of every series."""
    lengths = chain_lengths(draws)
    bulk, folded = bulk_and_folded(draws, lengths)
    tails = tail_indicators(draws, lengths, _all_ranks(draws, lengths, bulk), probs)
    kinds = F.array(
        F.struct(F.lit("bulk").alias("kind"), F.col("z").alias("x")),
        F.struct(F.lit("mean").alias("kind"), F.col("value").alias("x")),
        F.struct(F.lit("square").alias("kind"), (F.col("value") * F.col("value")).alias("x")),
    )
    rows = bulk.withColumn("k", F.explode(kinds)).select(*SERIES, "k.kind", "half", "h", "t", "k.x").unionByName(tails)
    sizes = effective_size(rows, [*SERIES, "kind"])

    def least(*names):
        return F.min(F.when(F.col("kind").isin(*names), F.col("ess")))

    ess = sizes.groupBy(*SERIES).agg(
        least("bulk").alias("ess_bulk"),
        least(*[f"q{i}" for i in range(len(probs))]).alias("ess_tail"),
        least("mean").alias("ess_mean"),
        least("mean", "square").alias("ess_sd"),
    )
    moments = draws.groupBy(*SERIES).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    interval = hdi_wide(hdi(draws, prob))
    r = rhat_rank(draws, (bulk, folded)).select(*SERIES, F.col("rhat").alias("r_hat"))
    out = moments.join(interval, SERIES).join(ess, SERIES).join(r, SERIES, "left")
    e = F.col("ess_sd")
    spread = F.sqrt(F.lit(math.e) * F.pow(1 - 1 / e, e - 1) - 1)
    return out.withColumn("mcse_mean", F.col("sd") / F.sqrt("ess_mean")).withColumn("mcse_sd", F.col("sd") * spread).drop("ess_mean", "ess_sd")


def gate(diagnosed: DataFrame, max_rhat: float = MAX_RHAT, min_ess: float = MIN_ESS) -> DataFrame:
    """Per model: series that miss each bound and whether the model passes.

    `diagnosed` has r_hat, ess_bulk and ess_tail per series; a missing value misses its bound.
    """

    def missed(ok):
        return F.count(F.when(~F.coalesce(ok, F.lit(False)), 1))

    out = diagnosed.groupBy("model").agg(
        F.count(F.lit(1)).alias("series"),
        missed(F.col("r_hat") < max_rhat).alias("rhat_fails"),
        missed(F.col("ess_bulk") > min_ess).alias("ess_bulk_fails"),
        missed(F.col("ess_tail") > min_ess).alias("ess_tail_fails"),
    )
    return out.withColumn("passed", (F.col("rhat_fails") + F.col("ess_bulk_fails") + F.col("ess_tail_fails")) == 0)


def violations(diagnosed: DataFrame, max_rhat: float = MAX_RHAT, min_ess: float = MIN_ESS) -> DataFrame:
    """Series that miss a bound."""
    ok = (F.col("r_hat") < max_rhat) & (F.col("ess_bulk") > min_ess) & (F.col("ess_tail") > min_ess)
    return diagnosed.where(~F.coalesce(ok, F.lit(False)))
