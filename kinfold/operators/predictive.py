"""Posterior-predictive simulation and frequency checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.columns import require
from kinfold.functions.digests import joined_uniforms
from kinfold.functions.values import BAND_Z, CATEGORIES, MODELS, N_CATEGORIES, SEED
from kinfold.operators.likelihood import pack_draws, spread_join
from kinfold.operators.network import count_histogram

# Balls and draws that one row carries.
BALLS, DRAWS = 8, 32
# Simulated rows that are worked on together.
SLICE = 1 << 15


def predict(rows: DataFrame, vectors: DataFrame, seed: int = SEED) -> DataFrame:
    """Simulated counts for every row and draw: (model, chain, draw, id, counts).

    Polya urn (Blackwell & MacQueen 1973): ball t takes type k with probability
    proportional to alpha_k plus the balls of type k so far. The uniform of a ball
    depends on (seed, model, chain, draw, id, t) only, so results do not move with
    partitioning or retries. Spark deals out rows and draws; a row carries BALLS balls of DRAWS draws, as rows cost more
    than bytes on their way to Python. Rows with more balls go on in further blocks, which follow each other. Each slice
    of an Arrow batch hashes its uniforms and takes all its t-th balls at once.
    """
    schema = ", ".join(["model string, chain int, draw int, id string", *[f"{c} long" for c in CATEGORIES]])
    return _balls(rows, vectors, seed).mapInArrow(_count_batches, schema)


def predict_cells(rows: DataFrame, vectors: DataFrame, seed: int = SEED) -> DataFrame:
    """The crosstab of `predict`, counted inside each Arrow batch before rows leave it."""
    schema = "model string, chain int, draw int, category string, y long, respondents long"
    counted = _balls(rows, vectors, seed).mapInArrow(_cell_batches, schema)
    return counted.groupBy("model", "chain", "draw", "category", "y").agg(F.sum("respondents").alias("respondents"))


def _few_draws(packs, seed):
    """Packs with their draws in arrays of DRAWS, and what the hashed text of every uniform of a draw begins with."""
    def few(i):
        some = F.slice("draws", i, DRAWS)
        return F.struct(
            F.transform(some, lambda d: d["chain"]).alias("chains"),
            F.transform(some, lambda d: d["draw"]).alias("draws"),
            F.transform(some, lambda d: F.concat_ws("|", F.lit(str(seed)), F.col("model"), d["chain"], d["draw"], F.lit(""))).alias("stems"),
            F.flatten(F.transform(some, lambda d: F.transform(d["frac"], lambda f: f * d["conc"]))).alias("alpha"),
        )

    return packs.withColumn("draws", F.transform(F.sequence(F.lit(1), F.size("draws"), F.lit(DRAWS)), few))


def _balls(rows, vectors, seed):
    """Rows and draws joined, a row for each block of balls of a few draws.

    The text of a uniform, as `hash_uniform` hashes it, is a draw's stem and a ball's tail.
    """
    require(rows, "model", "key", "id", "lender_ij")
    slim = rows.select("model", "key", "id", F.col("lender_ij").cast("long").alias("n"))
    names = ["model", "id", "n", "chains", "draws", "alpha", "stems"]
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(BALLS).cast("long"))
    joined = spread_join(slim, _few_draws(pack_draws(vectors), seed)).select(*names, F.explode(blocks).alias("first"))
    here = F.least(F.col("n") - F.col("first"), F.lit(BALLS).cast("long"))
    balls = F.when(here > 0, F.sequence(F.col("first") + 1, F.col("first") + here)).otherwise(F.array().cast("array<long>"))
    return joined.withColumn("tails", F.transform(balls, lambda t: F.concat_ws("|", F.col("id"), t)))


def _ragged(starts, lengths):
    """Places start, start + 1, ... of every stretch, in order."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def _simulated(batches):
    """(slice of a batch, draws of each row, simulated rows that end there, counts by type and simulated row).

    A simulated row is a row and one of its draws.
    """
    before = np.zeros((N_CATEGORIES, 0), np.int64)
    step = max(1, SLICE // DRAWS)
    for batch in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
        n, first = batch["n"].to_numpy(), batch["first"].to_numpy()
        width = batch["draws"].value_lengths().to_numpy().astype(np.int64)
        base = np.r_[0, np.cumsum(width)]
        here = np.clip(n - first, 0, BALLS)
        many = np.repeat(here, width)
        u_first = np.cumsum(many) - many
        u = joined_uniforms(
            batch["stems"].flatten(), batch["tails"].flatten(),
            np.repeat(np.arange(len(many)), many), _ragged(np.repeat(np.cumsum(here) - here, width), many),
        )
        alpha = batch["alpha"].flatten().to_numpy().reshape(-1, N_CATEGORIES).T.copy()
        y = np.zeros(alpha.shape, np.int64)
        block = first // BALLS
        mass = np.zeros(alpha.shape[1])
        for a in alpha:
            mass += a
        for level in range(int(block.max(initial=0)) + 1):
            rows = np.flatnonzero(block == level)
            # Longest first, so that the rows with a t-th ball come first.
            rows = rows[np.argsort(-here[rows], kind="stable")]
            each = _ragged(base[rows], width[rows])
            at = u_first[each]
            a, total, counts = alpha[:, each], mass[each], np.zeros((N_CATEGORIES, len(each)))
            if level and len(rows):
                # A block goes on from the row before, which may have been the last of the slice before.
                past = np.concatenate([before, y], axis=1)
                counts[:] = past[:, each - np.repeat(width[rows], width[rows]) + before.shape[1]]
            ends = np.cumsum(width[rows])
            for t in range(int(here[rows].max(initial=0))):
                m = int(ends[np.count_nonzero(here[rows] > t) - 1])
                v = u[at[:m] + t] * (total[:m] + level * BALLS + t)
                edge, kind = np.zeros(m), np.zeros(m, np.int8)
                for k in range(N_CATEGORIES - 1):
                    edge += a[k, :m] + counts[k, :m]
                    kind += v >= edge
                counts[kind, np.arange(m)] += 1
            y[:, each] = counts
        before = y[:, base[-2]:]
        ends = np.flatnonzero(np.repeat(first + BALLS >= n, width))
        yield batch, width, ends, y[:, ends]


def _count_batches(batches):
    for batch, width, ends, y in _simulated(batches):
        row = pa.array(np.repeat(np.arange(batch.num_rows), width)[ends])
        chain, draw = (batch[c].flatten().take(pa.array(ends)) for c in ("chains", "draws"))
        yield pa.RecordBatch.from_arrays(
            [batch["model"].take(row), chain, draw, batch["id"].take(row), *[pa.array(y[k]) for k in range(N_CATEGORIES)]],
            names=["model", "chain", "draw", "id", *CATEGORIES],
        )


def _cell_batches(batches):
    for batch, width, ends, y in _simulated(batches):
        model = batch["model"].dictionary_encode()
        chain, draw = (batch[c].flatten().to_numpy().astype("int64") for c in ("chains", "draws"))
        chains, draws = chain.max(initial=0) + 1, draw.max(initial=0) + 1
        seen, place = np.unique(((np.repeat(model.indices.to_numpy(), width) * chains + chain) * draws + draw)[ends], return_inverse=True)
        values = int(y.max(initial=0)) + 1
        cell = (place * N_CATEGORIES + np.arange(N_CATEGORIES)[:, None]) * values + y
        counts = np.bincount(cell.ravel())
        at = np.flatnonzero(counts)
        which = seen[at // (N_CATEGORIES * values)]
        types = pa.DictionaryArray.from_arrays(pa.array(at // values % N_CATEGORIES), pa.array(list(CATEGORIES)))
        yield pa.RecordBatch.from_arrays(
            [
                model.dictionary.take(pa.array(which // (chains * draws))),
                pa.array(which // draws % chains, pa.int32()), pa.array(which % draws, pa.int32()),
                types.dictionary_decode(), pa.array(at % values), pa.array(counts[at]),
            ],
            names=["model", "chain", "draw", "category", "y", "respondents"],
        )


def crosstab(predicted: DataFrame) -> DataFrame:
    """Rows of each draw with y lenders of a type; values a draw lacks have no row.

    Equal count vectors of a draw are counted before they are split into types.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("y")) for c in CATEGORIES])
    return (
        predicted.groupBy("model", "chain", "draw", *CATEGORIES).agg(F.count(F.lit(1)).alias("c"))
        .select("model", "chain", "draw", "c", F.explode(cells).alias("cell"))
        .groupBy("model", "chain", "draw", "cell.category", "cell.y")
        .agg(F.sum("c").alias("respondents"))
    )


def frequency_summary(cells: DataFrame, n_draws: int) -> DataFrame:
    """Mean and sample standard deviation of the cell counts over all draws.

    Draws without the value count as zero: with n draws that have it, their mean m and variance v, the squared
    deviations over all D draws add up to n v + n (D - n) / D m^2, which neither overflows nor cancels.
    """
    c = F.col("respondents").cast("double")
    sums = cells.groupBy("model", "category", "y").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v")
    )
    n, m, d = F.col("n"), F.col("m"), float(n_draws)
    spread = n * F.col("v") + n * (d - n) / d * m * m
    return sums.select("model", "category", "y", (n * m / d).alias("mean"), F.sqrt(spread / (d - 1)).alias("std"))


def compare_observed(summary: DataFrame, sample: DataFrame, models=MODELS) -> DataFrame:
    """Observed frequency of every value beside its predictive mean and deviation.

    The observed grid is the union of values over all types; predicted-only values drop
    out and observed-only values have no mean.
    """
    observed = count_histogram(sample).withColumn(
        "model", F.explode(F.array(*[F.lit(m) for m in models]))
    )
    joined = observed.join(summary, ["model", "category", "y"], "left")
    return joined.select(
        "model", F.concat(F.lit("Y_counts_"), "category").alias("category"),
        F.col("y").alias("number_of_lenders"), F.col("respondents").alias("y_observed_count"),
        F.col("mean").alias("y_count_ppc_mean"), F.col("std").alias("y_count_ppc_std"),
    )


def band(frequencies: DataFrame) -> DataFrame:
    """Mean +/- 1.96 deviations, and whether the observed frequency lies inside."""
    mean, std = F.col("y_count_ppc_mean"), F.col("y_count_ppc_std")
    out = frequencies.withColumn("y_count_ppc_upper", mean + BAND_Z * std).withColumn("y_count_ppc_lower", mean - BAND_Z * std)
    return out.withColumn("covered", F.col("y_observed_count").between(F.col("y_count_ppc_lower"), F.col("y_count_ppc_upper")))
