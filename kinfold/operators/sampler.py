"""Posterior sampling of the three hierarchical Dirichlet-Multinomial models.

Sufficient statistics are the tail counts, so a sweep never touches respondents. Given
the shared hyperparameters the keys are independent. Keys are dealt into buckets by their hash, whose keys
move together. A sweep draws the numbers of a bucket from a stream of (seed, model, chain, sweep, bucket),
those of the hyperparameters from another one, so a chain does not depend on where its buckets are: all in one
task while they are few, else in a Spark pass over the buckets per sweep that returns nine sums per chain. Only
the order of these sums differs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.values import (
    ALPHA_MU, ALPHA_SIGMA, CATEGORIES, CHAINS, DRAWS, LAMBDA_RATE, LAMBDA_SHAPE, MODELS, N_CATEGORIES, SEED, TUNE,
)
from kinfold.sources.workspace import materialise, parallelism, scratch_path

# Cells of sufficient statistics, and drawn vectors, that one task may hold.
TASK_CELLS = 200_000
TASK_VECTORS = 1_000_000
# Keys that a bucket has on average.
BUCKET_KEYS = 64
# Random-walk scales of the samplers.
CONC_SCALES = (0.15, 0.4, 1.0)
ALPHA_STEP, SCALE_STEP = 0.35, 0.25


@dataclass(frozen=True)
class RunLength:
    chains: int = CHAINS
    draws: int = DRAWS
    tune: int = TUNE
    seed: int = SEED


def key_statistics(tails: DataFrame) -> DataFrame:
    """One row per (model, key) with its tail counts as a list.

    A list has nine numbers per name a person can give at most, however many people there are.
    """
    code = F.when(F.col("category").isNull(), F.lit(N_CATEGORIES))
    for k, c in enumerate(CATEGORIES):
        code = code.when(F.col("category") == c, F.lit(k))
    return tails.groupBy("model", "key").agg(
        F.sort_array(F.collect_list(F.struct(code.alias("k"), F.col("j").cast("int").alias("j"), F.col("n_above").alias("n")))).alias("cells"),
        F.count(F.lit(1)).alias("n_cells"),
    )


class Block:
    """Tail counts of some keys as flat arrays, and the updates that need nothing else."""

    def __init__(self, cells):
        flat = np.array([(g, c["k"], c["j"], c["n"]) for g, key in enumerate(cells) for c in key], dtype="int64").reshape(-1, 4)
        typed = flat[flat[:, 1] < N_CATEGORIES]
        total = flat[flat[:, 1] == N_CATEGORIES]
        self.size = len(cells)
        self.g, self.k, self.j, self.v = typed.T
        self.ug, self.uj, self.u = total[:, 0], total[:, 2], total[:, 3]

    def start(self, rng):
        return np.full((self.size, N_CATEGORIES), 1.0 / N_CATEGORIES), rng.uniform(1.0, 5.0, self.size)

    def log_target(self, frac, conc, rate):
        """Log density of conc given frac, tables summed out, on the log scale."""
        rise = self.v * np.log(conc[self.g] * frac[self.g, self.k] + self.j)
        fall = self.u * np.log(conc[self.ug] + self.uj)
        return (
            np.bincount(self.g, rise, self.size) - np.bincount(self.ug, fall, self.size)
            - rate * conc + np.log(conc)
        )

    def update(self, rng, frac, conc, alpha, rate):
        """Tables (Antoniak 1974), simplexes given tables, then concentrations by random walk."""
        a = conc[self.g] * frac[self.g, self.k]
        tables = rng.binomial(self.v, a / (a + self.j))
        counts = np.bincount(self.g * N_CATEGORIES + self.k, tables, self.size * N_CATEGORIES).reshape(self.size, -1)
        draw = np.maximum(rng.standard_gamma(alpha + counts), 1e-300)
        frac = np.maximum(draw / draw.sum(axis=1, keepdims=True), 1e-300)
        now = self.log_target(frac, conc, rate)
        for scale in CONC_SCALES:
            proposal = conc * np.exp(scale * rng.standard_normal(self.size))
            then = self.log_target(frac, proposal, rate)
            moved = np.log(rng.random(self.size)) < then - now
            conc, now = np.where(moved, proposal, conc), np.where(moved, then, now)
        return frac, conc


def _log_alpha(alpha, keys, log_frac):
    """Log density of the shared Dirichlet parameters on the log scale, from the keys' summed log shares."""
    total = keys * math.lgamma(sum(alpha))
    for a, s in zip(alpha, log_frac):
        z = (math.log(a) - ALPHA_MU) / ALPHA_SIGMA
        total += (a - 1) * s - keys * math.lgamma(a) - 0.5 * z * z
    return total


def update_hyper(rng, alpha, keys, log_frac, conc_sum):
    """Rate by its Gamma conditional; alphas by two passes of single moves and one joint scale move."""
    rate = rng.gamma(LAMBDA_SHAPE + keys, 1.0 / (LAMBDA_RATE + conc_sum))
    alpha, log_frac = [float(a) for a in alpha], [float(s) for s in log_frac]
    now = _log_alpha(alpha, keys, log_frac)
    singles = [(k,) for _ in range(2) for k in range(N_CATEGORIES)]
    for types in [*singles, tuple(range(N_CATEGORIES))]:
        step = ALPHA_STEP if len(types) == 1 else SCALE_STEP
        factor = math.exp(step * rng.standard_normal())
        proposal = [a * factor if k in types else a for k, a in enumerate(alpha)]
        then = _log_alpha(proposal, keys, log_frac)
        if math.log(rng.random()) < then - now:
            alpha, now = proposal, then
    return np.array(alpha), rate


def _start_hyper():
    return np.full(N_CATEGORIES, math.exp(ALPHA_MU)), LAMBDA_SHAPE / LAMBDA_RATE


VECTOR_SCHEMA = "model string, key string, chain int, draw int, frac array<double>, conc double, hyper_alpha array<double>, hyper_lambda double"


def _bucket_stream(run: RunLength, model: str, chain: int, sweep: int, bucket: int):
    return np.random.default_rng([run.seed, MODELS.index(model), 1, chain, sweep, bucket])


def _hyper_stream(run: RunLength, model: str, chain: int, sweep: int):
    return np.random.default_rng([run.seed, MODELS.index(model), 2, chain, sweep])


def _move_bucket(block, rng, sweep, frac, conc, alpha, rate):
    """One sweep of the keys of a bucket; the first starts them."""
    if sweep == 0:
        frac, conc = block.start(rng)
    return block.update(rng, frac, conc, alpha, rate)


def _run_chain(run: RunLength):
    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        model, number = pdf["model"].iloc[0], int(pdf["chain"].iloc[0])
        pdf = pdf.sort_values(["bucket", "key"])
        keys, blocks = list(pdf["key"]), {int(b): Block(list(part["cells"])) for b, part in pdf.groupby("bucket")}
        state = [(None, None)] * len(blocks)
        alpha, rate = _start_hyper()
        fracs, concs, alphas, rates = [], [], [], []
        for sweep in range(run.tune + run.draws):
            state = [
                _move_bucket(block, _bucket_stream(run, model, number, sweep, b), sweep, *s, alpha, rate)
                for (b, block), s in zip(blocks.items(), state)
            ]
            frac, conc = np.concatenate([f for f, _ in state]), np.concatenate([c for _, c in state])
            alpha, rate = update_hyper(_hyper_stream(run, model, number, sweep), alpha, len(keys), np.log(frac).sum(axis=0), conc.sum())
            if sweep >= run.tune:
                fracs.append(frac)
                concs.append(conc)
                alphas.append(alpha)
                rates.append(rate)
        n = len(keys)
        return pd.DataFrame({
            "model": model, "key": np.tile(np.array(keys, dtype=object), run.draws), "chain": number,
            "draw": np.repeat(np.arange(run.draws), n),
            "frac": list(np.concatenate(fracs)), "conc": np.concatenate(concs),
            "hyper_alpha": [a for a in alphas for _ in range(n)], "hyper_lambda": np.repeat(rates, n),
        })

    return chain


def _fit_in_tasks(stats: DataFrame, run: RunLength) -> DataFrame:
    """One task per (model, chain)."""
    chains = F.explode(F.sequence(F.lit(0), F.lit(run.chains - 1))).alias("chain")
    return stats.select("model", "key", "bucket", "cells", chains).groupBy("model", "chain").applyInPandas(_run_chain(run), VECTOR_SCHEMA)


def _sweep_bucket(run: RunLength, model: str, sweep: int, hyper: dict):
    """Advance the keys of a bucket by one sweep."""

    def advance(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        chain, bucket = int(pdf["chain"].iloc[0]), int(pdf["bucket"].iloc[0])
        now = (np.stack(pdf["frac"]), pdf["conc"].to_numpy()) if sweep else (None, None)
        frac, conc = _move_bucket(Block(list(pdf["cells"])), _bucket_stream(run, model, chain, sweep, bucket), sweep, *now, *hyper[chain])
        return pd.DataFrame({"key": pdf["key"], "chain": chain, "frac": list(frac), "conc": conc})

    return advance


def _fit_by_sweeps(stats: DataFrame, model: str, run: RunLength) -> DataFrame:
    """One Spark pass over the buckets per sweep; each pass is a written table, so a lost executor costs one pass."""
    spark = stats.sparkSession
    path = scratch_path(spark, "sweeps")
    chains = F.explode(F.sequence(F.lit(0), F.lit(run.chains - 1))).alias("chain")
    cells = materialise(stats.select("key", "bucket", "cells", chains).repartition(parallelism(spark), "bucket", "chain"), "cells")
    state = cells.select("key", "chain", F.lit(None).cast("array<double>").alias("frac"), F.lit(None).cast("double").alias("conc"))
    hyper = {c: _start_hyper() for c in range(run.chains)}
    kept = []
    for sweep in range(run.tune + run.draws):
        moved = cells.join(state, ["key", "chain"]).groupBy("bucket", "chain").applyInPandas(
            _sweep_bucket(run, model, sweep, hyper), "key string, chain int, frac array<double>, conc double"
        )
        moved.write.parquet(f"{path}/sweep={sweep}")
        state = spark.read.schema(moved.schema).parquet(f"{path}/sweep={sweep}")
        logs = [F.sum(F.log(F.element_at("frac", k + 1))).alias(f"s{k}") for k in range(N_CATEGORIES)]
        for r in state.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.sum("conc").alias("c"), *logs).collect():
            rng = _hyper_stream(run, model, r["chain"], sweep)
            log_frac = np.array([r[f"s{k}"] for k in range(N_CATEGORIES)])
            hyper[r["chain"]] = update_hyper(rng, hyper[r["chain"]][0], r["n"], log_frac, r["c"])
        if sweep >= run.tune:
            kept += [(c, sweep, [float(a) for a in hyper[c][0]], float(hyper[c][1])) for c in hyper]
    table = spark.createDataFrame(kept, "chain int, sweep int, hyper_alpha array<double>, hyper_lambda double")
    every = spark.read.schema("key string, chain int, frac array<double>, conc double, sweep int").parquet(path)
    return (
        every.where(F.col("sweep") >= run.tune).join(F.broadcast(table), ["chain", "sweep"])
        .select(
            F.lit(model).alias("model"), "key", "chain", (F.col("sweep") - run.tune).cast("int").alias("draw"),
            "frac", "conc", "hyper_alpha", "hyper_lambda",
        )
    )


def fit(tails: DataFrame, run: RunLength = RunLength(), task_cells: int = TASK_CELLS) -> tuple[DataFrame, DataFrame]:
    """(vectors, hyper) drawn from the posterior of every model in the tail counts, written once.

    Models whose statistics fit one task run a chain per task; larger ones run by sweeps.
    """
    stats = materialise(key_statistics(tails), "statistics")
    sizes = stats.groupBy("model").agg(F.sum("n_cells").alias("cells"), F.count(F.lit(1)).alias("keys")).collect()
    if not sizes:
        raise ValueError("there are no tail counts to fit")
    buckets = F.create_map(*[F.lit(x) for r in sizes for x in (r["model"], -(-r["keys"] // BUCKET_KEYS))])[F.col("model")]
    stats = stats.withColumn("bucket", F.pmod(F.xxhash64("key"), buckets))
    small = [r["model"] for r in sizes if r["cells"] <= task_cells and r["keys"] * run.draws <= TASK_VECTORS]
    parts = [_fit_in_tasks(stats.where(F.col("model").isin(small)), run)] if small else []
    large = [r["model"] for r in sizes if r["model"] not in small]
    parts += [_fit_by_sweeps(stats.where(F.col("model") == m), m, run) for m in large]
    drawn = parts[0]
    for p in parts[1:]:
        drawn = drawn.unionByName(p)
    drawn = materialise(drawn, "posterior")
    hyper = drawn.groupBy("model", "chain", "draw").agg(
        F.first("hyper_alpha").alias("hyper_alpha"), F.first("hyper_lambda").alias("hyper_lambda")
    )
    return drawn.select("model", "key", "chain", "draw", "frac", "conc"), hyper
